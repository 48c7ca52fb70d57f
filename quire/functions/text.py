"""Scalar functions on lines, titles, markdown and values, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches define results.
LINE_END = r"\R|[\x1c-\x1e]"  # \R: \r\n, or one of \n \r \x0b \x0c \x85 \u2028 \u2029
HEADING = r"^(#{1,6})\s+(.*\S)\s*$"
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+\S"
LIST_LIKE = r"^\d+\.\s+\d"
FENCE = r"^\s*(```|~~~)"
SEPARATOR = r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$"
SEPARATOR_ROW = r"^\s*\|[\s:|-]+\|\s*$"
TABLE_ROW = r"^\s*\|.*\|\s*$"
#: A mention starts with see, refer or a form of page: the look at two characters spares the pattern nearly all places.
PAGE_REFERENCE = r"(?i)(?=[srp][eag.])((?:see|refer(?:\s+to)?)\s+)?(page\s*no\.?|page|pg\.?|p\.)\s*(\d{1,4})\b"
VARYING = (r"(?i)(?=[pvi])\b(?:p(?:g\.?|age)\s*\d+\s*of\s*\d+|ver\.?\s*:|issue\s*:\s*\d)", r"(?i)^(?:man/[a-z0-9/]+|\s*date\s*:)")
SIGN_OFF = ("prepared by", "issued by", "approved by", "reviewed by", "authorized by")


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def canonical(adopted: Column, baseline: Column) -> Column:
    """The adopted text, else the baseline, else empty; an empty text falls through too."""
    return F.coalesce(F.nullif(adopted, F.lit("")), F.nullif(baseline, F.lit("")), F.lit(""))


def tokens(text: Column) -> Column:
    """Words for fidelity scores: lower case, markdown marks blanked, runs of a-z and 0-9."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"[#*_`>\-|]", " "), F.lit("[a-z0-9]+"), F.lit(0))


def word_text(text: Column) -> Column:
    """The tokens of a text, with blanks between: marks are no part of a token, so what stands between tokens is one blank."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")


def tokens_without_tags(text: Column) -> Column:
    """As tokens, with <tags> blanked first."""
    return tokens(F.regexp_replace(F.lower(text), "<[^>]+>", " "))


def lines(text: Column) -> Column:
    """Lines of a text, at any of the line ends; a final empty one does not count. Only the last characters are looked at for that."""
    last = F.right(text, F.lit(2))
    end = F.length(last) - F.length(F.regexp_replace(last, f"(?:{LINE_END})\\z", ""))
    return F.split(F.when(end > 0, F.left(text, F.length(text) - end)).otherwise(text), LINE_END, -1)


def boilerplate_form(line: Column) -> Column:
    return F.lower(strip(F.regexp_replace(line, r"[#*_`>\-\s]+", " ")))


def furniture_form(line: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "#"), r"\s+", " "))


def title_form(title: Column) -> Column:
    return F.lower(strip(F.regexp_replace(title, r"\s+", " ")))


def label_form(label: Column) -> Column:
    """Labels that differ in case or spacing alone are one; sharp s folds to ss."""
    return F.replace(title_form(label), F.lit("ß"), F.lit("ss"))


def clean_title(raw: Column) -> Column:
    return strip(F.regexp_replace(strip(raw), r"^[*_]+|[*_]+$", ""))


def number_level(title: Column, fallback: Column) -> Column:
    """Level from numbering such as 1.2.3 (dots and one, at most 6), else the fallback."""
    number = F.regexp_extract(title, NUMBERED, 1)
    return F.when(number != "", F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."))) + 1)).otherwise(fallback)


def chapter(title: Column) -> Column:
    return F.regexp_extract(title, r"^(\d+)\b", 1).try_cast("bigint")


def looks_like_list_item(title: Column) -> Column:
    return F.contains(title, F.lit("*")) | title.rlike(LIST_LIKE)


def slug(text: Column) -> Column:
    short = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("page"))


def plain_text(markdown: Column) -> Column:
    """Markdown or HTML without tags and marks, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(markdown, "<[^>]+>", " "), r"[#*_`>|-]+", " ")
    return strip(F.regexp_replace(bare, r"\s+", " "))


def cell_count(line: Column) -> Column:
    """Cells of a table row; an escaped pipe separates none."""
    s = F.regexp_replace(strip(line), r"^\|", "")
    return F.size(F.split(F.regexp_replace(s, r"(?<!\\)\|$", ""), r"(?<!\\)\|", -1))


def column_count(row: Column) -> Column:
    """Columns of a row, all outer pipes stripped, every pipe a separator."""
    return F.size(F.split(F.regexp_replace(strip(row), r"^\|+|\|+$", ""), r"\|", -1))


def is_table_line(line: Column) -> Column:
    s = strip(line)
    return s.startswith("|") & s.endswith("|") & (F.length(s) >= 2)


def is_pipe_line(line: Column) -> Column:
    return strip(line).startswith("|")


def is_varying(line: Column) -> Column:
    """Page and version marks of VARYING. Those that may stand anywhere are tried where a word that begins with p, v or i starts."""
    return line.rlike(VARYING[0]) | line.rlike(VARYING[1])


def is_sign_off(line: Column) -> Column:
    """A pipe-delimited row with two sign-off phrases or more. Most lines have no pipe and are done with."""
    s = strip(line)
    hits = sum((F.contains(F.lower(s), F.lit(p)).cast("int") for p in SIGN_OFF), F.lit(0))
    return F.contains(line, F.lit("|")) & s.startswith("|") & s.endswith("|") & (hits >= 2)


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 16))


def block_markdown(kind: Column, text: Column, level: Column) -> Column:
    return F.when(kind == "heading", strip(F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), text))).otherwise(text)


def block_label(kind: Column, text: Column) -> Column:
    return F.when(kind == "table", F.lit("Table")).when(kind == "heading", text).otherwise(F.substring(text, 1, 80))


def path_depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, " > "), lambda p: F.trim(p) != ""))


def or_default(value: Column, default) -> Column:
    """A setting: null and empty give the default."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def number_or(value: Column, default: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def exact_mean(value: Column) -> Column:
    """The mean of an aggregated column to three digits, halves up; values count to nine digits, and their sum is exact in any order."""
    return F.round(F.sum(value.cast("decimal(18,9)")) / F.count(value), 3).cast("double")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 1 where there is nothing to cover."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…[truncated]"))).otherwise(text)


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))


def warning(code: Column, message: Column, severity: Column, page: Column, block: Column) -> Column:
    return F.struct(code.alias("code"), severity.alias("severity"), message.alias("message"), page.alias("page_number"), block.alias("block_id"))


def page_kind(text: Column, images: Column, drawings: Column) -> Column:
    """visual: little text (under 250 characters) and an image or 40 drawings."""
    return F.when((F.length(strip(text)) < 250) & ((images > 0) | (drawings >= 40)), "visual").otherwise("text")


# Keys under which a model's reply holds its markdown, and a response its cost, in order.
REPLY_KEYS, COST_KEYS = ("markdown", "md", "text", "content"), ("cost", "total_cost", "cost_usd")
# Fixed value: a reply that claims an action.
CLAIM = (
    r"(?i)\bI(?:'ve| have)\s+(?:now\s+|just\s+|already\s+)?"
    r"(?:moved|renamed|re-?tagged|re-?parsed|re-?classified|regenerated|embedded|"
    r"toggled|set the (?:section )?type|created the (?:section )?type)\b"
)


def file_slug(value: Column) -> Column:
    """A file name: runs of other characters than letters, digits, dot, underscore and hyphen become one underscore."""
    short = F.regexp_replace(F.regexp_replace(strip(value), "[^a-zA-Z0-9._-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("untitled"))


def table_cells(markdown: Column) -> Column:
    """Cells of a table's rows, separators passed over: row and column from 0, text."""
    rows = F.filter(lines(markdown), lambda ln: is_table_line(ln) & ~ln.rlike(SEPARATOR_ROW))
    parts = lambda ln: F.split(F.regexp_replace(strip(ln), r"^\|+|\|+$", ""), r"\|", -1)
    return F.flatten(F.transform(rows, lambda ln, i: F.transform(parts(ln), lambda v, k: F.struct(i.alias("row"), k.alias("column"), strip(v).alias("text")))))


def option_kind(value: Column) -> Column:
    """The kind that an option's value is read as: bool, null, int, float or string."""
    low = F.lower(value)
    whole, real = value.rlike(r"^\s*[+-]?[0-9]+\s*$"), value.try_cast("double").isNotNull()
    return F.when(low.isin("true", "false"), "bool").when(low == "null", "null").when(whole, "int").when(real, "float").otherwise("string")


def json_members(value: Column) -> Column:
    """Under v the one JSON value that a text is, as VARIANT; null where it is anything else, or is followed by anything.

    The parser stops after the first value, so the text is put into an object and has to be followed by a member named after its own hash.
    Members that repeat a name within one object make it no JSON here.
    """
    mark = F.concat(F.lit("m"), F.xxhash64(value).cast("string"))
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), value, F.lit('\n,"'), mark, F.lit('":1}')))
    members = F.try_variant_get(whole, "$", "map<string,variant>")
    return F.when((F.size(members) == 2) & F.map_contains_key(members, mark), members)


def json_value(value: Column) -> Column:
    """The JSON value that a text is, as VARIANT; null where it is none."""
    return F.element_at(json_members(value), "v")


def is_json(value: Column) -> Column:
    """Whether a text is one JSON value and nothing else; blanks around it do not count."""
    return json_members(value).isNotNull()


def json_object(value: Column) -> Column:
    """The members of the JSON object that a text is, as a map to VARIANT; null where it is none."""
    return F.try_variant_get(json_value(value), "$", "map<string,variant>")


def json_object_or_empty(value: Column) -> Column:
    """The text if it is a JSON object, else {}."""
    return F.when(json_object(value).isNotNull(), value).otherwise(F.lit("{}"))


def json_length(value: Column) -> Column:
    """The elements of the JSON array that a text is; 0 where it is none."""
    return F.coalesce(F.size(F.try_variant_get(json_value(value), "$", "array<variant>")), F.lit(0)).cast("bigint")


def sorted_json(entries: Column) -> Column:
    """JSON of a map, keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def salvaged_json(raw: Column) -> Column:
    """The JSON in a reply: within its first fence or else whole, and if that is none the outermost braces; null without any."""
    fence = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = strip(F.when(raw.rlike(r"(?s)```(?:json)?\s*.*?```"), fence).otherwise(raw))
    brace = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(is_json(body), body).when(is_json(brace), brace)


def reply_markdown(content: Column) -> Column:
    """The markdown of a model's reply: of an object that of the first of REPLY_KEYS there is (null: empty), of other text the text itself, trimmed."""
    members, other = json_object(content), json_value(content)
    of = F.lit("")
    for key in reversed(REPLY_KEYS):
        of = F.when(F.map_contains_key(members, key), F.coalesce(F.element_at(members, key).cast("string"), F.lit(""))).otherwise(of)
    text = F.when(F.schema_of_variant(other) == "STRING", other.cast("string")).otherwise(strip(content))
    return F.when(F.coalesce(content, F.lit("")) == "", "").when(members.isNotNull(), of).otherwise(text)


def reply_cost(response: Column) -> Column:
    """Cost of a call: the first of COST_KEYS that usage holds (0 and empty pass) or else the response; 0 where it is no number."""
    at = lambda path: F.get_json_object(response, path)
    present = [F.coalesce(F.when(~F.coalesce(at(f"$.usage.{k}"), F.lit("")).isin("", "0", "0.0", "false"), at(f"$.usage.{k}")), at(f"$.{k}")) for k in COST_KEYS]
    return F.coalesce(F.coalesce(*present).try_cast("double"), F.lit(0.0))


def run_id(profile: Column) -> Column:
    """A new id for a run: the profile's file slug and a random suffix."""
    return F.concat(F.lit("run_"), F.substring(file_slug(profile), 1, 32), F.lit("_"), F.substring(F.replace(F.uuid(), F.lit("-")), 1, 12))


def utc(at: Column) -> Column:
    """A time as ISO text in UTC, to the second. The session's zone must be UTC or at hold UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def shown_text(text: Column, at: Column, marker: str, within: int = 200) -> Column:
    """Whether a marker stands within so many characters after a place."""
    return F.contains(F.substring(text, at, F.lit(within)), F.lit(marker))


def without_private(entries: Column) -> Column:
    """A map without the keys that start with an underscore."""
    return F.map_filter(entries, lambda k, v: ~k.startswith("_"))
