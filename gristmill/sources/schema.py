"""The schema that every source is normalised to."""

OFFER = "source string, title string, company string, location string, description string, url string, posted_at string, salary string, native_key string"
OFFER_FIELDS = [part.split()[0] for part in OFFER.split(", ")]
