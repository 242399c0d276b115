"""WARC round trips and main-text extraction: nulls, empty and long pages,
repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import random
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from gristmill.llm import html_text, warc


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", *(F.lit("x").alias(c) for c in ("digest", "payload", "refers_to", "archive", "text2")))


def pages():
    rnd = random.Random(1)
    big = "".join(rnd.choice("abcdefgh <>é") for _ in range(300_000))
    return [(1, "http://a/é b\nc", "x" * 1200), (2, "u", "x" * 1200), (3, "u", "x" * 1200), (4, "u", "short"), (5, "u", "short"), (6, None, None), (7, "u", ""), (8, "u", big), (9, "u", big), (9, "u", big), (None, "u", "y" * 2000), (10, "u", "y" * 2000)]


def test_warc_round_trip_over_small_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_TASKS", 16)
    rows = pages()
    archives = warc.write(frame(spark, rows), str(tmp_path / "w"), archive_bytes=20_000)
    listed = archives.collect()
    assert sum(r["records"] for r in listed) == len(rows) and len(listed) >= 2
    for split in (97, 4096, 1 << 20):
        found = warc.read(archives, split_bytes=split).collect()
        assert len(found) == len(rows)
        for r in found:
            want = next((h or "").encode() for i, _, h in rows if i == r["page_id"] and hashlib.sha1((h or "").encode()).hexdigest() == r["payload_digest"])
            assert r["payload_bytes"] == len(want) and (r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == want)
        kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in found), key=str)
        rest = [(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 9), (9, "response", None), (9, "response", None), (None, "revisit", 10), (10, "response", None)]
        assert kinds == sorted(rest, key=str)
        assert {r["page_id"]: r["url"] for r in found}[1] == "http://a/é b\nc"
    assert warc.write(frame(spark, []).limit(0), str(tmp_path / "none")).count() == 0
    data = b"".join(Path(r["archive"]).read_bytes() for r in listed)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(rows)


def test_magic_inside_a_member_is_not_a_record():
    inner = warc.member(b"no record: " + bytes(range(256)) * 20)
    stored = warc.member(warc.record(1, "u", inner + warc.MAGIC * 50, hashlib.sha1(inner + warc.MAGIC * 50).hexdigest(), None), level=0)
    data = b"junk" + stored + inner + warc.member(warc.record(2, "u", b"z", hashlib.sha1(b"z").hexdigest(), None)) + stored[:200]
    for split in (50, 333, len(data)):
        got = [(o, raw is not None) for s in range(0, len(data), split) for o, raw in warc.Range(io.BytesIO(data), s, s + split, len(data)).records()]
        assert got == [(4, True), (4 + len(stored) + len(inner), True), (len(data) - 200, False)]
    assert warc.parse(warc.record(3, "u", b"ab", hashlib.sha1(b"ac").hexdigest(), None))[2:5] == (warc.DAMAGED, 2, hashlib.sha1(b"ab").hexdigest())


def test_archives_are_read_by_many_tasks_and_damage_is_reported(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(k, "u", "".join(rnd.choice("abcdef") for _ in range(3000))) for k in range(60)]
    archives = warc.write(frame(spark, rows), str(tmp_path / "w"), archive_bytes=20_000)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    found = warc.read(archives, split_bytes=4096).select("*", F.spark_partition_id().alias("task")).collect()
    assert len(found) == 60 and len({r["task"] for r in found}) > 4
    one = archives.first()
    path = Path(one["archive"])
    path.write_bytes(path.read_bytes()[:-50])
    found = warc.read(archives.where(F.col("archive") == one["archive"]).withColumn("bytes", F.col("bytes") - 50)).collect()
    assert [r["record_type"] for r in found].count(warc.DAMAGED) == 1 and len(found) == one["records"]


def test_damage_in_the_middle_of_an_archive_is_a_row():
    rnd = random.Random(3)
    bodies = [bytes(rnd.randrange(256) for _ in range(4000)) for _ in range(5)]
    members = [warc.member(warc.record(k, "u", b, hashlib.sha1(b).hexdigest(), None)) for k, b in enumerate(bodies)]
    broken = bytearray(members[2])
    broken[3000] ^= 0x10
    data = b"".join([*members[:2], bytes(broken), *members[3:]])
    for split in (777, len(data)):
        found = [(o, raw is not None) for s in range(0, len(data), split) for o, raw in warc.Range(io.BytesIO(data), s, s + split, len(data)).records()]
        starts = [sum(map(len, members[:k])) for k in range(5)]
        assert found == [(o, k != 2) for k, o in enumerate(starts)]


def test_records_of_other_writers():
    def record(*headers, body=b"HTTP/1.1 200 OK\r\n\r\nabc"):
        return b"WARC/1.0\r\n" + b"".join(h + b"\r\n" for h in headers) + b"\r\n" + body + b"\r\n\r\n"

    sha = hashlib.sha1(b"abc").hexdigest()
    base = (b"WARC-Type: response", b"WARC-Target-URI: http://x/", b"Content-Length: 22")
    assert warc.parse(record(*base)) == (None, "http://x/", "response", 3, sha, None, b"abc")
    assert warc.parse(record(*base, b"WARC-Payload-Digest: sha1:" + sha.upper().encode()))[2:5] == ("response", 3, sha)
    assert warc.parse(record(*base, b"WARC-Payload-Digest: sha256:00ff"))[2:5] == ("response", 3, sha)
    assert warc.parse(record(*base, b"WARC-Payload-Digest: sha1:" + hashlib.sha1(b"x").hexdigest().encode()))[2] == warc.DAMAGED
    assert warc.parse(record(b"WARC-Type: revisit", b"WARC-Payload-Digest: md5:77", b"X-Page-Id: none", body=b""))[:6] == (None, None, "revisit", None, "md5:77", None)
    assert warc.parse(record(b"WARC-Type: metadata")) is None


def test_trees_are_built_in_linear_time():
    for page in ("<div>" * 100_000 + "</p>" * 100_000, "<td>" + "<table>" * 50_000 + "<div>" * 50_000 + "</td>" * 100_000, "<ul><li>" + "<div>" * 60_000 + "<li>" * 60_000):
        began = time.process_time()
        nodes, _ = html_text.tree(page + "end")
        assert len(nodes) > 50_000 and time.process_time() - began < 20


def test_marginals_match_enumeration():
    rnd = np.random.default_rng(2)
    parents = [-1, 0, 0, 1, 1, 2]
    nodes = [html_text.Node("t", p, []) for p in parents]
    own, edges = rnd.uniform(0.2, 5, 6).tolist(), [tuple(x) for x in rnd.uniform(0.2, 5, (6, 4)).tolist()]
    total, want = 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        w = np.prod([o if v else 1.0 for o, v in zip(own, y)]) * np.prod([edges[k][2 * y[parents[k]] + y[k]] for k in range(1, 6)])
        total += w
        want += w * np.array(y)
    assert np.allclose(html_text.marginals(nodes, own, edges)[0], want / total)


MENU = "<ul><li><a href='/x'>Start</a><li><a href='/y'>Topics</a></ul>"
STORY = "The town has kept its bridge, and the council will pay for it until next year."


def test_layouts_that_were_not_trained_on():
    model = html_text.fit(html_text.LABELLED)
    get = lambda page: html_text.main_text(page, model)
    assert get(f"<html><body><nav class=top>{MENU}</nav><article><h1>Bridge &amp; road</h1><p>{STORY}<p>A  second\n one&nbsp;here.<br>More</p></article><footer>Imprint</footer>") == f"Bridge & road\n{STORY}\nA second one here. More"
    other = f"<body><div class='cookie notice'><p>{STORY}</p></div><header>{MENU}</header><main><h2>Title</h2><p>{STORY}</p><script>if (a < b) x('</p>')</script><style>p{{}}</style></main><section id=comments><h3>Comments</h3><p>{STORY}</p></section><aside class=sidebar>{MENU}<p>{STORY}</p></aside><form><label>Mail</label></form></body>"
    assert get(other) == f"Title\n{STORY}"
    assert get("") == get("<html><body></body></html>") == get("<!-- only -->") == ""
    assert get(f"<article><p>{STORY}</p><p>cut &am") == f"{STORY}\ncut &am"


#: Layouts of other kinds than those trained on, their main text between square brackets.
FOREIGN = [
    f"<body><div id=masthead>{MENU}</div><div class=blogpost>[<h2>Bridge</h2><p>{STORY}</p><p>{STORY}</p>]</div><div id=disqus_thread><h4>Leave a reply</h4><p>I like it a lot.</p></div><div class=site-info>&copy; 2021</div></body>",
    f"<body><table><tr><td id=leftnav>{MENU}</td><td class=maincell>[<h1>Bridge</h1><p>{STORY}</p><p>Short one.</p>]</td><td class=rightads>Buy now! Shoes and more shoes</td></tr></table></body>",
    f"<body><header role=banner><a href=/>Site</a></header><div class='documentation page'>[<h1>Install</h1><p>{STORY}</p><pre>make all</pre><ol><li>First, open the box.</li><li>Then close it again.</li></ol>]</div><nav class=toc>{MENU}</nav></body>",
    f"<body><div class=topbar>{MENU}</div><article class=hentry>[<h1>News</h1><p>{STORY}</p>]<div class='sharing buttons'><a href=#>Tweet</a> <a href=#>Mail</a></div></article><section id=more-stories><h3>More stories</h3>{MENU}</section><footer>Terms</footer></body>",
    f"<body><div class='gdpr notice'><p>{STORY}</p><button>OK</button></div><main>[<p>{STORY}</p><dl><dt>Length</dt><dd>Ninety metres in all.</dd></dl>]</main><aside><p>{STORY}</p></aside></body>",
    f"<body><div id=wrap><div id=hd>{MENU}</div><div id=bd>[<h1>On bridges</h1><p>{STORY}</p><p>{STORY} {STORY}</p><figure><figcaption>The old bridge.</figcaption></figure>]</div><div id=ft><p>Imprint, privacy</p></div></div></body>",
]


def test_precision_and_recall_on_foreign_layouts():
    model = html_text.fit(html_text.LABELLED)
    hit = told = true = 0
    for page in FOREIGN:
        before, inside, after = page.replace("]", "[").split("[")
        nodes, blocks = html_text.tree(before + "<x-y></x-y>" + inside + after)
        content, _ = html_text.marginals(nodes, *model.potentials(nodes, html_text.features(nodes, blocks)))
        own = {t for _, t in html_text.tree(inside)[1]}
        elsewhere = [t for part in (before, after) for _, t in html_text.tree(part)[1]]
        size = lambda ts: sum(map(len, ts))
        got = [t for k, t in blocks if content[k] >= html_text.LIMIT]
        good = [t for t in got if t in own]
        extra = size(t for t in set(elsewhere) & own if got.count(t) > 1)
        hit, told, true = hit + size(good) - extra, told + size(got), true + size(t for _, t in blocks if t in own and t not in elsewhere) + size(t for t in own if t in elsewhere)
    print(f"precision {hit / told:.3f}, recall {hit / true:.3f}")
    assert hit / told > 0.9 and hit / true > 0.9, (hit / told, hit / true)


def test_held_out_pages_of_the_training_set():
    right = total = 0
    for k in range(len(html_text.LABELLED)):
        model = html_text.fit(html_text.LABELLED[:k] + html_text.LABELLED[k + 1 :])
        nodes, blocks = html_text.tree(html_text.LABELLED[k])
        content, _ = html_text.marginals(nodes, *model.potentials(nodes, html_text.features(nodes, blocks)))
        right += sum((content[n] >= 0.5) == bool(nodes[n].label) for n, _ in blocks)
        total += len(blocks)
    assert right / total > 0.85, right / total


def test_extraction_on_odd_rows(spark):
    deep = "<div>" * 3000 + "<article><p>deep</p></article>"
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "plain text"), (4, "u", f"<article><p>{STORY * 2000}</p></article>"), (4, "u", f"<article><p>{STORY}</p></article>"), (None, None, "<"), (5, "u", deep), (6, "u", "<a b='" + "x" * 100_000)]
    found = html_text.extract(frame(spark, rows)).collect()
    assert len(found) == len(rows) and all(r["text"] is not None for r in found)
    assert {r["text"] for r in found if r["page_id"] in (1, 2)} == {""}
    assert html_text.extract(frame(spark, []).limit(0)).count() == 0
