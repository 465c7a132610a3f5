"""Front matter, titles and entities of notes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.functions.text import LINE_START, WS, trim_ws

MAP = "map<string,struct<is_list:boolean,values:array<string>>>"
#: What separates a tag from the text before it, and what it may be made of.
INLINE_TAG = rf"(?:\A|(?<={WS[:-1]}(\[{{>]))#([A-Za-z][A-Za-z0-9_/-]{{1,64}}(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=[/-])(?=[A-Za-z0-9_])))"
WIKI_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"


def _unix(raw: Column) -> Column:
    return F.regexp_replace(raw, "\r\n", "\n")


def _fence_end(raw: Column) -> Column:
    """Where the closing fence of the front matter begins, in the text with plain line ends; 0 without front matter."""
    opens = raw.startswith("---\n") | raw.startswith("---\r\n")
    return F.when(opens, F.locate("\n---\n", _unix(raw), 5)).otherwise(0)


def frontmatter_block(raw: Column) -> Column:
    """The lines between the fences; null where a note has no front matter."""
    end = _fence_end(raw)
    return F.when(end > 0, F.substring(_unix(raw), F.lit(5), end - 5))


def body(raw: Column) -> Column:
    """The note without front matter; as it is, line ends too, where it has none."""
    end = _fence_end(raw)
    return F.when(end > 0, F.substring(_unix(raw), end + 5, F.length(raw))).otherwise(raw)


def clean_yaml(c: Column) -> Column:
    return F.regexp_replace(trim_ws(c), r"\A['\"]|['\"]\z", "")


def parse_yaml(block: Column) -> Column:
    """key -> (is_list, values) of simple YAML lines, later keys over earlier ones.

    A key without a value begins a list; the items below it are added until another line comes. Blank lines and comments
    don't end a list. A fold over the lines; null for a null block.
    """
    nothing = F.array().cast("array<string>")

    def step(state: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, rf"{WS}+\z", "")
        skipped = line.rlike(rf"\A{WS}*(?:#|\z)")
        item = F.regexp_extract(line, rf"\A{WS}*-{WS}+([^\n\r]+)\z", 1)
        key = F.lower(F.regexp_extract(line, r"\A([A-Za-z0-9_-]+):", 1))
        value = F.regexp_extract(line, rf"\A[A-Za-z0-9_-]+:{WS}*([^\n\r]*)\z", 1)
        listed = F.regexp_extract(trim_ws(value), r"\A\[([^\n\r]*)\]\z", 1)
        is_listed = trim_ws(value).rlike(r"\A\[[^\n\r]*\]\z")
        active, held = state["active"], state["held"]
        put = lambda k, is_list, values: F.map_concat(F.map_filter(held, lambda x, _: x != k), F.map_from_arrays(F.array(k), F.array(F.struct(is_list.alias("is_list"), values.alias("values"))))).cast(MAP)
        keep = F.struct(active.alias("active"), held.alias("held"))
        as_item = F.struct(active.alias("active"), put(active, F.lit(True), F.concat(F.coalesce(held[active]["values"], nothing), F.array(clean_yaml(item)))).alias("held"))
        parts = F.filter(F.transform(F.split(listed, ","), clean_yaml), lambda x: x != "")
        as_key = F.when(value == "", F.struct(key.alias("active"), put(key, F.lit(True), nothing).alias("held"))).otherwise(
            F.struct(F.lit("").alias("active"), F.when(is_listed, put(key, F.lit(True), parts)).otherwise(put(key, F.lit(False), F.array(clean_yaml(value)))).alias("held"))
        )
        other = F.struct(F.lit("").alias("active"), held.alias("held"))
        return F.when(skipped, keep).when((item != "") & (active != ""), as_item).when(key != "", as_key).otherwise(other)

    start = F.struct(F.lit("").alias("active"), F.create_map().cast(MAP).alias("held"))
    return F.when(block.isNotNull(), F.aggregate(F.split(block, "\n"), start, step, lambda s: s["held"]))


def normalize_tag(c: Column) -> Column:
    return F.lower(F.regexp_replace(trim_ws(c), r"\A#", ""))


def frontmatter_list(fm: Column, key: str) -> Column:
    """The tags under a key: the items of a list or the comma-separated parts of a value."""
    entry = fm[key]
    values = F.when(entry["is_list"], entry["values"]).otherwise(F.split(entry["values"][0], ","))
    tags = F.filter(F.transform(values, normalize_tag), lambda t: t != "")
    return F.coalesce(tags, F.array().cast("array<string>"))


def title(body_: Column, file_name: Column) -> Column:
    """The first heading of the first level, else the file name without its extension."""
    heading = trim_ws(F.regexp_extract(body_, rf"{LINE_START}#{WS}+([^\n\r\u2028\u2029]+)", 1))
    bare = F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]+\z", ""), "[-_]+", " ")
    found = F.regexp_extract(body_, rf"{LINE_START}#{WS}+([^\n\r\u2028\u2029]+)", 1) != ""
    return F.when(found, heading).otherwise(bare)


def inline_tags(body_: Column) -> Column:
    """Tags in the text, in order of place, as often as they stand; code isn't left out."""
    return F.transform(F.regexp_extract_all(body_, F.lit(INLINE_TAG), F.lit(1)), normalize_tag)


def wiki_links(body_: Column) -> Column:
    """Targets of wiki links, in order of place."""
    found = F.regexp_extract_all(body_, F.lit(WIKI_LINK), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(trim_ws(x), rf"{WS}+", " ")), lambda x: x != "")


def folders(relative_path: Column) -> Column:
    """The root and every folder above a note."""
    parts = F.filter(F.split(F.regexp_replace(relative_path, r"\\", "/"), "/"), lambda p: p != "")
    n = F.size(parts) - 1
    above = F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit(".")), above))


def normalize_name(kind: str, name: Column) -> Column:
    clean = F.regexp_replace(trim_ws(name), rf"{WS}+", " ")
    if kind == "tag":
        return normalize_tag(clean)
    return F.regexp_replace(clean, r"\A/+|/+\z", "") if kind == "folder" else clean


def entity_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), normalize_name(kind, name))


def entity_type(id_: Column) -> Column:
    kind = F.substring_index(id_, ":", 1)
    return F.when(kind.isin("tag", "link", "folder"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown entity type in id: "), id_)))


def entity_name(id_: Column) -> Column:
    return F.when(F.locate(":", id_) == 0, id_).otherwise(F.substring(id_, F.locate(":", id_) + 1, F.length(id_)))


def display_name(kind: Column, name: Column) -> Column:
    folder = F.when(name == ".", "root folder").when(name != "", F.concat(F.lit("folder:"), name)).otherwise("folder:.")
    return F.when(kind == "tag", F.concat(F.lit("#"), name)).when(kind == "link", F.concat(F.lit("[["), name, F.lit("]]"))).otherwise(folder)


def tags_of(fm: Column, body_: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(frontmatter_list(fm, "tags"), inline_tags(body_))))


def links_of(body_: Column) -> Column:
    return F.array_sort(F.array_distinct(wiki_links(body_)))


def entity_ids(tags: Column, links: Column, folders_: Column) -> Column:
    """The entities of a note, sorted."""
    ids = F.concat(F.transform(tags, lambda t: entity_id("tag", t)), F.transform(links, lambda x: entity_id("link", x)), F.transform(folders_, lambda f: entity_id("folder", f)))
    return F.array_sort(F.array_distinct(ids))


def stable_id(relative_path: Column) -> Column:
    """base64url of the path without padding."""
    return F.translate(F.base64(F.encode(relative_path, "UTF-8")), "+/=\r\n", "-_")


def short_sha(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)
