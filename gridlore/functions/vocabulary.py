"""Target schema and word lists, and the dimension tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The target fields in order: name, type, description, allowed values, schema aliases, domain aliases.
FIELDS = [
    (
        "Reference",
        "string",
        "Unique reference or identifier for the insured location.",
        [],
        [
            "reference", "ref", "location reference", "location id", "location number", "site reference", "site id",
        ],
        [
            "ref", "ref no", "ref number", "reference no", "reference number", "reference id", "location reference",
            "location id", "location number", "loc number", "loc no", "loc id",
        ],
    ),
    (
        "Address",
        "string",
        "Street address of the insured location.",
        [],
        [
            "address", "street address", "property address", "location address", "site address",
        ],
        [
            "address", "street address", "property address", "site address", "location address", "street", "street name",
            "address line", "address line 1", "address line 2", "addr",
        ],
    ),
    (
        "City",
        "string",
        "City or town of the insured location.",
        [],
        [
            "city", "town", "city name", "town name",
        ],
        [
            "city", "city name", "town", "town name", "city town", "city / town", "municipality", "municipality name",
        ],
    ),
    (
        "State",
        "string",
        "State or province of the insured location.",
        [],
        [
            "state", "state code", "state name", "province", "state/province",
        ],
        [
            "state", "state name", "state code", "state abbreviation", "province", "province name", "state prov", "st",
        ],
    ),
    (
        "Zip",
        "integer",
        "ZIP or postal code of the insured location.",
        [],
        [
            "zip", "zip code", "zipcode", "postal code", "postal",
        ],
        [
            "zip", "zip code", "zipcode", "postal code", "postal", "postcode", "post code", "zip number",
        ],
    ),
    (
        "County",
        "string",
        "County of the insured location.",
        [],
        [
            "county", "county name",
        ],
        [
            "county", "county name", "county code",
        ],
    ),
    (
        "Country",
        "string",
        "Country of the insured location.",
        [],
        [
            "country", "country name", "country code",
        ],
        [
            "country", "country name", "country code", "nation",
        ],
    ),
    (
        "Building Value",
        "float",
        "Replacement or insured value associated with the building.",
        [],
        [
            "building value", "building replacement value", "building replacement cost", "replacement cost",
            "replacement cost new", "building cost", "bldg value", "bldg repl cost new", "bldg repl cost", "building repl cost",
        ],
        [
            "bldg value", "building val", "bldg val", "building replacement value", "building replacement cost",
            "building repl cost", "bldg repl cost", "replacement cost", "replacement cost new", "repl cost", "repl cost new",
            "building cost", "bldg cost", "replacement value", "repl value", "property value", "property valuation",
            "building valuation", "building amount", "building limit", "building limit value",
        ],
    ),
    (
        "Contents",
        "float",
        "Insured value of contents, machinery, equipment, or similar property contents.",
        [],
        [
            "contents", "contents value", "contents replacement value", "contents cost", "machinery", "equipment",
            "machinery equipment", "contents machinery equipment",
        ],
        [
            "contents value", "contents val", "content value", "contents cost", "contents replacement value",
            "contents replacement cost", "machinery value", "equipment value", "machinery equipment", "machinery and equipment",
            "contents machinery equipment", "contents amount", "contents limit", "bpp", "business personal property",
            "business personal property value", "bpp value",
        ],
    ),
    (
        "BI",
        "float",
        "Business interruption value.",
        [],
        [
            "bi", "business interruption", "business income", "business income value", "bi value", "business interruption value",
        ],
        [
            "business interruption", "business interruption value", "business income", "business income value", "bi value",
            "bi amount", "business income amount", "business interruption amount", "business interruption limit",
            "business income limit", "bi limit", "bi amount value",
        ],
    ),
    (
        "Occupancy",
        "string",
        "Primary occupancy or use of the insured location.",
        [],
        [
            "occupancy", "occupancy type", "property occupancy", "building occupancy", "use", "property use",
        ],
        [
            "occupancy type", "property occupancy", "building occupancy", "occupancy class", "property use", "building use",
            "use type", "use", "occupancy description", "occupancy code", "occupancy classification",
        ],
    ),
    (
        "Construction",
        "string",
        "Construction type or construction classification of the building.",
        [],
        [
            "construction", "construction type", "construction class", "building construction", "construction code",
        ],
        [
            "construction type", "construction class", "construction code", "building construction",
            "construction classification", "bldg construction", "construction description", "construction category",
            "construction material", "building construction type",
        ],
    ),
    (
        "Storeys",
        "integer",
        "Number of storeys or floors in the building.",
        [],
        [
            "storeys", "stories", "story", "storey", "number of storeys", "number of stories", "floors", "number of floors",
        ],
        [
            "stories", "story", "storey", "number of stories", "number of storeys", "number of floors", "floor count",
            "story count", "storey count", "of stories", "no of stories", "no of storeys", "floors", "floor number",
            "building floors",
        ],
    ),
    (
        "Number of Buildings",
        "integer",
        "Number of buildings at the insured location.",
        [],
        [
            "number of buildings", "building count", "number buildings", "no of buildings", "no. of buildings", "buildings",
            "building number",
        ],
        [
            "building count", "number buildings", "number of building", "number of buildings", "no of buildings", "no buildings",
            "no of bldgs", "number of bldgs", "building number", "bldg count", "number buildings at location", "of buildings",
            "no of building", "bldgs count", "building quantity", "number of structures", "structure count",
        ],
    ),
    (
        "Year Built",
        "integer",
        "Year in which the building was constructed.",
        [],
        [
            "year built", "year of construction", "construction year", "built year", "year constructed", "built",
        ],
        [
            "year of construction", "construction year", "year constructed", "built year", "year built", "built",
            "construction yr", "year constructed", "yr built", "built yr", "year",
        ],
    ),
    (
        "Fire Sprinklers (Y/N)",
        "string",
        "Fire sprinkler protection indicator.",
        ["Y", "N", "Y13", "Y(13R)"],
        [
            "fire sprinklers", "fire sprinkler", "sprinklers", "sprinkler", "fire sprinkler protection", "sprinkler protection",
            "fire sprinklers y n", "fire sprinkler y n",
        ],
        [
            "fire sprinklers", "fire sprinkler", "sprinklers", "sprinkler", "sprinklered", "sprinkler", "sprinkler system",
            "fire sprinkler system", "sprinkler protection", "sprinkler protection system", "sprinklered percentage",
            "sprinkler percentage", "sprinkler %", "percent sprinklered", "% sprinklered", "fire protection sprinkler",
        ],
    ),
    (
        "Other",
        "float",
        "Other applicable insured value not represented by the specified target fields.",
        [],
        [
            "other", "other value", "other amount", "other property", "miscellaneous", "misc",
        ],
        [
            "other", "other value", "other amount", "other property", "other property value", "other exposure",
            "other exposure value", "other limit", "other assets", "other asset value",
        ],
    ),
]

# Words of header rows, of whole sheets, and of sheet roles.
TERMS = {
    "header": [
        "location", "loc", "location number", "location no", "loc number", "loc no", "building", "bldg", "building value",
        "bldg value", "facility", "address", "street", "city", "state", "zip", "zip code", "postal", "county", "country",
        "construction", "construction type", "year built", "year", "built", "value", "replacement", "replacement cost",
        "replacement value", "sprinkler", "sprinklers", "fire sprinkler", "occupancy", "occupancy type", "property",
        "property value", "contents", "business interruption", "bi", "total value", "tiv", "limit", "deductible", "coverage",
        "roof", "roof type", "stories", "storeys", "square feet", "sq ft", "area",
    ],
    "keyword": [
        "location", "loc", "building", "bldg", "facility", "address", "street", "city", "state", "zip", "postal", "construction",
        "year built", "value", "replacement", "sprinkler", "occupancy", "property",
    ],
    "deny_name": [
        "glossary", "confidentiality", "disclaimer", "disclaimers", "questions", "yoy", "comparison", "summary", "autos",
        "trailer", "equipment",
    ],
    "secondary_name": [
        "deleted", "elsewhere", "business interruption", "bi values",
    ],
    "primary": [
        "loc", "loc #", "location", "location id", "location name", "building", "bldg", "bldg #", "facility", "facility name",
        "companies and locations", "address", "city", "city / town", "state", "zip", "country", "latitude", "longitude",
        "construction", "construction type", "year built", "occupancy", "insured occupancy", "protection class", "sprinkler",
        "sprinkler %", "square footage", "sq. ft.", "buildings", "buildings and installations", "contents",
        "contents, machinery, equipment", "machinery & equipment values", "business personal property", "stock", "total pd",
        "tiv", "bi", "bi value", "business interruption", "total bi", "total overall", "total",
    ],
    "identity": [
        "loc", "loc #", "location", "location id", "location name", "bldg", "bldg #", "building", "facility", "facility name",
        "complex/facility", "companies and locations", "address", "street", "street address", "city", "city / town", "latitude",
        "longitude",
    ],
    "attribute": [
        "construction", "construction type", "year built", "occupancy", "insured occupancy", "protection class", "sprinkler",
        "sprinkler %", "square footage", "sq. ft.", "sq. ft", "#floor", "no. of stories", "no. of bldgs", "buildings",
        "buildings and installations", "contents", "contents, machinery, equipment", "machinery & equipment values",
        "business personal property", "stock", "building values", "building value", "total pd", "tiv", "bi", "bi value",
        "business interruption", "total bi", "total overall", "total",
    ],
}

#: position, name, type, description, allowed values, schema aliases, domain aliases.
TARGETS = [(i, *field) for i, field in enumerate(FIELDS)]
TARGET_NAMES = [t[1] for t in TARGETS]


def quoted(items: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def values_sql(rows: list[tuple]) -> str:
    """The rows as a VALUES list of either engine."""
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


def alias_rows() -> list[tuple[int, int, str, str]]:
    """source (0: name, 1: schema alias, 2: domain alias), position, text, target."""
    out, pos = [], 0
    for kind in ("schema", "domain"):
        for _, name, _, _, _, schema, domain in TARGETS:
            for source, text in [(0, name), *((1, a) for a in schema)] if kind == "schema" else [(2, name), *((2, a) for a in domain)]:
                out.append((source, pos, text, name))
                pos += 1
    return out


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TARGETS, "target_pos int, target string, data_type string, description string, allowed array<string>, aliases array<string>, domain_aliases array<string>")


def aliases(spark: SparkSession) -> DataFrame:
    """Every name and alias, unnormalised: source, pos, alias, target. Its size is fixed by this file."""
    return spark.createDataFrame(alias_rows(), "source int, pos int, alias string, target string")
