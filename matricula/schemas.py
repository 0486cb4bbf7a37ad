"""Fixed schemas of the tables that are read from or written to files."""

from __future__ import annotations

from matricula import fixed_values as V

_CULTURE = ",".join(f"{a}:double" for a in V.CULTURE_AXES)

TIER1 = (
    "id string, name string, country string, location string, region string, setting string, "
    "type string, avg_gpa double, net_price double, enrollment_editorial double, "
    f"majors array<string>, culture struct<{_CULTURE}>"
)
NOTABLE_PERSON = (
    "struct<name:string,known_for:string,fields:array<string>,status:string,prominence:int,"
    "awards:array<string>,source:string,source_url:string>"
)
ACTIVE_PERSON = (
    "struct<name:string,research:array<string>,fields:array<string>,recent_works:int,"
    "last_active:int,h_index:int,awards:array<string>,source:string,source_url:string>"
)
NOTABLE_ENTRY = f"struct<notable_faculty:array<{NOTABLE_PERSON}>,category:string,retrieved_at:string>"
ACTIVE_ENTRY = f"struct<active_faculty:array<{ACTIVE_PERSON}>,institution:string,retrieved_at:string>"
RESEARCH_ENTRY = "struct<faculty:string,research:string,src:string,_retrieved:string>"
SCHOOL = (
    "school_id string, name string, slug string, country string, state string, homepage string, "
    "control string, source_fields map<string,string>"
)
RAW_PAGE = (
    "school_id string, school_name string, profile_url string, directory_url string, "
    "http_status int, fetched_at timestamp, html string"
)
PROFESSOR = (
    "school_id string, school_name string, professor_name string, title string, "
    "is_faculty boolean, department string, email string, phone string, "
    "research_interests string, profile_url string, directory_url string, "
    "extraction_confidence double, extracted_at timestamp"
)
# JSON-valued text columns of the relational catalog and their types.
CATALOG_JSON_COLUMNS = {
    "programs": "array<struct<name:string,share:double>>",
    "notable_faculty": f"array<{NOTABLE_PERSON}>",
    "active_faculty": f"array<{ACTIVE_PERSON}>",
    "majors": "array<string>",
    "culture": f"struct<{_CULTURE}>",
    "population": "struct<international_share:double,women_share:double,first_gen_share:double>",
    "details": "map<string,string>",
    "provenance": "map<string,string>",
}
CATALOG_COLUMNS = (
    "id", "unitid", "name", "country", "location", "state", "region", "setting", "type",
    "avg_gpa", "avg_sat", "acceptance_rate", "net_price", "sticker_tuition", "tuition_in_state",
    "programs", "notable_faculty", "active_faculty", "enrollment", "size", "majors", "culture",
    "population", "url", "net_price_calculator_url", "details", "provenance",
)
