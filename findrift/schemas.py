"""Record schemas, as DDL strings."""

CATALOG = (
    "id STRING, title STRING, overview STRING, release_date STRING, vote_average DOUBLE, "
    "vote_count INT, popularity DOUBLE, genres ARRAY<STRING>, runtime INT, budget BIGINT, "
    "revenue BIGINT, poster_path STRING, backdrop_path STRING, original_language STRING, "
    "tagline STRING, keywords ARRAY<STRING>, "
    "cast ARRAY<STRUCT<name: STRING, character: STRING, order: BIGINT, profile_path: STRING>>, "
    "director STRING"
)

# One raw record per id: the main part with credits and keywords nested in it.
# `status_code` is present only on error records.
DETAIL = (
    "id BIGINT, title STRING, overview STRING, release_date STRING, vote_average DOUBLE, "
    "vote_count INT, popularity DOUBLE, genres ARRAY<STRUCT<name: STRING>>, runtime INT, "
    "budget BIGINT, revenue BIGINT, poster_path STRING, backdrop_path STRING, "
    "original_language STRING, tagline STRING, "
    "keywords STRUCT<keywords: ARRAY<STRUCT<name: STRING>>>, "
    "credits STRUCT<cast: ARRAY<STRUCT<name: STRING, character: STRING, order: BIGINT, "
    "profile_path: STRING>>, crew: ARRAY<STRUCT<name: STRING, job: STRING>>>, "
    "status_code INT"
)

ID_EXPORT = "id BIGINT, popularity DOUBLE"

EVENT = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

BULK_RESPONSE = (
    "errors BOOLEAN, items ARRAY<STRUCT<index: STRUCT<status: INT, "
    "error: STRUCT<type: STRING, reason: STRING>>>>"
)
