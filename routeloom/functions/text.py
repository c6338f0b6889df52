"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The technology terms, signal words and forbidden terms below must
# equal the published lists, otherwise counts differ.
TECHNOLOGY_TERMS = (
    r"(?i)\b(?:react\.?js|react framework|vue|angular|svelte|three\.?js|gsap|webgl|webgpu|css|javascript|typescript|"
    r"framer[- ]motion|tailwind|shader|glsl|canvas api)\b"
)
SOURCE_SIGNAL = (
    "(?i)animation|transition|transform|keyframes|scroll|wheel|pointer|mousemove|touch|drag|canvas|webgl|three|shader|"
    "clip-path|mask|blend|filter|perspective|sticky|parallax|video|marquee|carousel|gallery|hover|intersectionobserver|"
    "requestanimationframe|gsap|lenis|lottie|motion|spring|inertia"
)
COMPOSITION_SIGNAL = (
    r"(?i)data-(?:component|w-id|scroll|speed|hover|image|tres)|class=|<canvas|<video|<svg|position:\s*(?:fixed|sticky)|"
    r"mix-blend|stroke-dash|will-change|overflow:\s*hidden|aspect-ratio|grid-template|background-image"
)
APPLICATION_TERMS = [
    r"\bReact(?:\.js)?\b",
    r"\bReact Three Fiber\b",
    r"\bVue(?:\.js)?\b",
    r"\bSvelte(?:Kit)?\b",
    r"\bAngular\b",
    r"\bAstro\b",
    r"\bHaxe\b",
    r"(?i)\bnative DOM\b",
    r"(?i)\bvanilla (?:DOM|JavaScript|JS)\b",
    r"(?i)\bsingle[- ](?:file|HTML)\b",
    r"(?i)\bcomponent[- ]based\b",
    r"(?i)\bcomponentized\b",
    r"\bSSR\b",
    r"\bCSR\b",
    r"\bSSG\b",
    r"\bJSX\b",
    r"\bTSX\b",
    r"\bVite\b",
    r"\bWebpack\b",
    r"\bParcel\b",
]
TECHNOLOGY_PATTERNS = [
    r"\bAstro\b",
    r"(?i)\bBlender\b",
    r"(?i)\bcanvas\b",
    r"(?i)\bCSS Only\b",
    r"(?i)\bFramer Motion\b",
    r"(?i)\bGSAP\b",
    r"(?i)\bHaxe\b",
    r"(?i)\bLocomotive Scroll\b",
    r"(?i)\bOGL\b",
    r"(?i)\bPixi(?:\.js)?\b",
    r"\bReact(?:\.js)?\b",
    r"(?i)\bReact Three Fiber\b",
    r"(?i)\bSVG\b",
    r"(?i)\bThree(?:\.js|js)\b",
    r"(?i)\bTSL\b",
    r"(?i)\bWeb Audio API\b",
    r"(?i)\bWebGL\b",
    r"(?i)\bWebGPU\b",
    r"(?i)\bGLSL\b",
]
FRAMEWORK_TERMS = (
    r"(?i)\b(?:React(?:\.js)?|Vue(?:\.js)?|Svelte(?:Kit)?|Angular|Astro|JSX|TSX|SSR|CSR|SSG|Vite|Webpack|Parcel)\b"
)
QUOTA_MARKERS = ["monthly_request_count", "servicequotaexceeded", "you have reached the limit"]
SNAKE_CASE = "^[a-z0-9]+(?:_[a-z0-9]+)*$"
KEBAB_CASE = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
CJK = "[㐀-鿿]"
DATA_URI = "data:[^;\"']+;base64,[A-Za-z0-9+/=]{256,}"
EMBEDDED_MARK = "[embedded-data-removed]"


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def word_count(text: Column) -> Column:
    """Number of whitespace separated words; 0 for blank text."""
    flat = collapse_ws(text)
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " ")))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_text(text), " "), lambda t: t != ""))


def token_jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token arrays; two empty sets are equal."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(left, right)).cast("double") / union
    )


def scrub_data_uri(text: Column) -> Column:
    return F.regexp_replace(text, DATA_URI, EMBEDDED_MARK)


def break_markup(text: Column, suffix: Column) -> Column:
    """Line breaks between tags (markup) and after braces and semicolons (markup, styles, scripts)."""
    markup = [".html", ".htm", ".vue", ".svelte", ".astro"]
    script = [".css", ".scss", ".sass", ".less", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"]
    tags = F.when(suffix.isin(markup), F.regexp_replace(text, ">\\s*<", ">\n<")).otherwise(text)
    return F.when(suffix.isin(markup + script), F.regexp_replace(tags, "([{};])", "$1\n")).otherwise(text)


def signal_line(line: Column) -> Column:
    return line.rlike(SOURCE_SIGNAL) | line.rlike(COMPOSITION_SIGNAL)


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def technology_hit(text: Column) -> Column:
    return text.rlike(TECHNOLOGY_TERMS)


def first_forbidden(text: Column) -> Column:
    """Matched text of the first application term, else the first technology term."""
    hits = [
        F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
        for pattern in APPLICATION_TERMS + TECHNOLOGY_PATTERNS
    ]
    return F.coalesce(*hits)


def is_snake(name: Column) -> Column:
    return name.rlike(SNAKE_CASE)


def is_kebab(name: Column, longest: int = 64) -> Column:
    return name.rlike(KEBAB_CASE) & (F.length(name) <= longest)


def safe_slug(text: Column, longest: int = 120, default: str = "skill") -> Column:
    runs = F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")
    cut = F.substring(F.regexp_replace(runs, "^[._-]+|[._-]+$", ""), 1, longest)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def append_requirements(original: Column, addition: Column) -> Column:
    base = F.regexp_replace(original, "\\s+$", "")
    extra = F.regexp_replace(F.coalesce(addition, F.lit("")), "^\\s+|\\s+$", "")
    return F.when(extra == "", base).otherwise(F.concat(base, F.lit("\n\n"), extra))


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, "(?U)\\A[\\s\\x1C-\\x1F]+|[\\s\\x1C-\\x1F]+\\z", "")


def reply_text(body: Column) -> Column:
    """Message text of a chat reply: a string, or the shown text parts of a list, one a line.

    Parts of other types (reasoning, images) are left out; any other content is null.
    """
    content = F.try_variant_get(F.try_parse_json(body), "$.choices[0].message.content", "variant")
    parts = F.filter(
        F.try_variant_get(content, "$", "array<variant>"),
        lambda p: F.coalesce(F.try_variant_get(p, "$.type", "string").isin("text", "output_text"), F.lit(False)),
    )
    texts = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    plain = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    return strip(F.coalesce(F.array_join(texts, "\n"), plain))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_json_object(text: Column) -> Column:
    """Text of the first object in a reply that reads as JSON, else null.

    A code fence around the whole reply is dropped.  The opening braces are tried in order,
    later ones only while none has been read; an object with a repeated key does not read.
    Its end is where the braces outside of strings balance.
    """
    bare = F.regexp_replace(strip(text), "(?i)\\A```(?:json)?\\s*|\\s*```\\z", "")
    return let(bare, lambda b: let(_first_opening(b), lambda at: _balanced(F.substring(b, at, F.length(b)))))


def _first_opening(bare: Column) -> Column:
    """Place of the first opening brace from which the text reads as JSON, null where there is none."""
    none = F.lit(None).cast("int")

    def visit(state: Column, piece: Column) -> Column:
        at = state["at"] + F.length(piece) + 1
        reads = F.try_parse_json(F.substring(bare, at, F.length(bare))).isNotNull()
        tried = F.struct(at.alias("at"), F.when(reads, at).alias("found"))
        return F.when(state["found"].isNotNull(), state).otherwise(tried)

    pieces = F.split(bare, "\\{")
    before_braces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.aggregate(before_braces, F.struct(F.lit(0).alias("at"), none.alias("found")), visit)["found"]


def _balanced(rest: Column) -> Column:
    """A text that opens with a brace, up to where the braces outside of strings balance."""
    plain = F.regexp_replace(rest, "(?s)\\\\.", "__")  # escapes keep their length but end no string
    tokens = F.regexp_extract_all(plain, F.lit('(?:"[^"]*")?[^"{}]*[{}]?'), F.lit(0))

    def close(state: Column, token: Column) -> Column:
        # a string, what follows it and at most one brace, the last letter
        depth = state["depth"] + F.when(token.endswith("{"), 1).when(token.endswith("}"), -1).otherwise(0)
        read = F.struct(depth.alias("depth"), (state["size"] + F.length(token)).alias("size"))
        return F.when((state["depth"] == 0) & (state["size"] > 0), state).otherwise(read)

    opened = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"))
    return F.substring(rest, F.lit(1), F.aggregate(tokens, opened, close)["size"])


#: Namespace of name-based identifiers of addresses (RFC 4122); a fixed value.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def stable_id(version: Column, key: Column) -> Column:
    """Name-based identifier (version 5, address namespace) of ``version:key``."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(F.concat(version, F.lit(":"), key), "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def sorted_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def route_pool(primary: Column, pool: Column) -> Column:
    """Primary first, then the listed routes, blanks and repeats removed."""
    listed = F.split(F.coalesce(pool, F.lit("")), "[,\\s]+")
    return F.array_distinct(F.filter(F.concat(F.array(F.trim(primary)), listed), lambda r: r != ""))


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def prefixed_number(text: Column, prefix: str, width: int = 4) -> Column:
    """``0012-name`` becomes ``prefix0012``; null where there is no four digit prefix."""
    digits = F.nullif(F.regexp_extract(text, "^(\\d{4})[-_]", 1), F.lit(""))
    return F.concat(F.lit(prefix), F.lpad(digits.cast("int").cast("string"), width, "0"))


def candidate_key(case_id: Column, index: Column) -> Column:
    return F.format_string("%s__s%02d", case_id, index)


def failure_class(error: Column, http_status: Column, validation: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    quota = reduce(lambda a, b: a | b, [low.contains(marker) for marker in QUOTA_MARKERS])
    return (
        F.when(validation, F.lit("validation"))
        .when(quota, F.lit("quota"))
        .when(http_status.isNotNull(), F.concat(F.lit("http="), http_status.cast("string")))
        .otherwise(F.lit("transport"))
    )


def front_matter(text: Column) -> Column:
    """struct(name, description, body, ok): exactly the two keys, quotes removed."""
    head = F.regexp_extract(text, "(?s)\\A---[^\\S\\n]*\\n(.*?)\\n---[^\\S\\n]*\\n(.*)\\z", 1)
    body = F.regexp_extract(text, "(?s)\\A---[^\\S\\n]*\\n(.*?)\\n---[^\\S\\n]*\\n(.*)\\z", 2)
    lines = F.split(head, "\n")
    keys = F.transform(lines, lambda l: F.trim(F.substring_index(l, ":", 1)))

    def value(key: str) -> Column:
        raw = F.trim(F.regexp_extract(head, f"(?m)^\\s*{key}\\s*:(.*)$", 1))
        unquoted = F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw) - 2), "''", "'")
        decoded = F.try_variant_get(F.try_parse_json(raw), "$", "string")
        return F.when(raw.startswith('"'), decoded).when(
            raw.startswith("'") & raw.endswith("'"), unquoted
        ).otherwise(raw)

    name, description = value("name"), value("description")
    ok = (
        (head != "")
        & F.forall(lines, lambda l: l.contains(":"))
        & (F.array_sort(keys) == F.array(F.lit("description"), F.lit("name")))
        & (F.coalesce(F.trim(name), F.lit("")) != "")
        & (F.coalesce(F.trim(description), F.lit("")) != "")
    )
    return F.struct(name.alias("name"), description.alias("description"), body.alias("body"), ok.alias("ok"))
