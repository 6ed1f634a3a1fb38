"""Schemas of the input tables; every reader states its types instead of inferring them."""

ITEM_MASTER = (
    "ITEM_ID bigint, OWNING_COLLECTION int, OWNING_COLLECTION_DES string, "
    "DATE_ISSUED_YEAR int, TITLE string"
)
ITEM_IDENTIFIER = "ITEM_ID bigint, IDE_DOI string, IDE_ISBN string, IDE_PMID string"
ITEM_DESCRIPTION = "ITEM_ID bigint, DES_ALLPEOPLE string, DES_NUMBEROFAUTHORS int"
ITEM_PUBLISHER = "ITEM_ID bigint, PUB_NAME string, PUB_PLACE string, PUB_COUNTRY string"
ITEM_LANGUAGE = "ITEM_ID bigint, LAN_ISO string"
ITEM_RELATION = "ITEM_ID bigint, REL_ISPARTOFBOOK string, REL_ISPARTOFJOURNAL string"
META = "id string, title string, type string, pub_date string"
INDEX = "id string, citing string, cited string"
TYPE_MAPPING = "iris_type string, meta_type string"
MATCH_RESULT = (
    "item_id bigint, matched_title string, doi string, issn string, "
    "ambiguous_match boolean, score double"
)
