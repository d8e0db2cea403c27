"""The parts of a transcript: display blocks and attachments, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.operators.normalize import is_object, member, raw_array, spaced

#: Characters of a JSON text that are shown, and of an attachment.
JSON_CHARS, ATTACHMENT_CHARS = 4000, 20_000
#: What an item of a block holds: a link's address and site, or null; ``form`` is text, link or json.
ITEM = "struct<form:string,body:string,url:string,site:string>"


def blocks(messages: DataFrame) -> DataFrame:
    """(conv_uuid, uuid, pos, kind, title, note, items): what is shown of a message, in order.

    Texts and thinking have their text. A call has its name, its message as ``note`` and its input as JSON, whole. A result has
    its name and an item for each of its parts: a link (knowledge, or whatever has an address) by title, address and
    site, a text as it is, anything else as JSON cut at ``JSON_CHARS`` characters. Other blocks have their type and their JSON, cut
    alike. Budgets and images are skipped; a message of which nothing shows has its plain text as one block.
    """
    kind = lambda b: member(b, "type")
    null = F.lit(None).cast("string")
    given = lambda b, *names: F.coalesce(*[F.nullif(member(b, n), F.lit("")) for n in names])
    item = lambda form, body, url=null, site=null: F.struct(F.lit(form).alias("form"), body.alias("body"), url.alias("url"), site.alias("site"))
    shown = F.filter(raw_array(F.col("raw"), "$.content"), lambda b: is_object(b) & ~F.coalesce(kind(b).isin("token_budget", "image"), F.lit(False)))
    short = lambda b: F.substring(spaced(b), 1, JSON_CHARS)

    def part(x: Column) -> Column:
        address = F.coalesce(given(x, "url"), F.lit(""))
        site = F.coalesce(F.nullif(F.get_json_object(x, "$.metadata.site_name"), F.lit("")), F.get_json_object(x, "$.metadata.site_domain"), F.lit(""))
        link = F.coalesce(kind(x) == "knowledge", F.lit(False)) | (address != "")
        own = F.when(link, item("link", F.coalesce(given(x, "title", "url"), F.lit("link")), address, site)).when(member(x, "text").isNotNull(), item("text", member(x, "text"))).otherwise(item("json", short(x)))
        return F.when(is_object(x), own).otherwise(item("text", x))

    def parts(b: Column) -> Column:
        content = member(b, "content")
        # a string that looks like a list is a text; only what the block holds as a list is one
        listed = F.coalesce(F.schema_of_variant(F.try_parse_json(F.to_json(F.from_json(b, "content variant")))).contains("content: ARRAY"), F.lit(False))
        single = F.when(content.isNotNull(), F.array(part(content))).otherwise(F.array().cast(f"array<{ITEM}>"))
        return F.when(listed, F.transform(raw_array(content), part)).otherwise(single)

    def row(b: Column) -> Column:
        made = lambda k, title, items, note=null: F.struct(F.lit(k).alias("kind"), title.alias("title"), note.alias("note"), items.alias("items"))
        text = F.array(item("text", F.coalesce(member(b, "text"), F.lit(""))))
        call = F.when(member(b, "input").isNotNull(), F.array(item("json", spaced(member(b, "input"))))).otherwise(F.array().cast(f"array<{ITEM}>"))
        return (
            F.when(kind(b) == "text", made("text", null, text))
            .when(kind(b) == "thinking", made("thinking", null, text))
            .when(kind(b) == "tool_use", made("call", F.coalesce(given(b, "name"), F.lit("tool")), call, given(b, "message")))
            .when(kind(b) == "tool_result", made("result", F.coalesce(given(b, "name"), F.lit("result")), parts(b)))
            .otherwise(made("other", F.coalesce(kind(b), F.lit("None")), F.array(item("json", short(b)))))
        )

    # a text without words shows nothing
    rows = F.filter(F.transform(shown, row), lambda r: ~((r["kind"] == "text") & (F.get(r["items"], F.lit(0))["body"] == "")))
    flat = F.array(F.struct(F.lit("text").alias("kind"), null.alias("title"), null.alias("note"), F.array(item("text", F.coalesce(member(F.col("raw"), "text"), F.lit("")))).alias("items")))
    filled = F.when(F.size(rows) > 0, rows).otherwise(flat)
    return messages.select("conv_uuid", "uuid", F.posexplode(filled).alias("pos", "b")).select("conv_uuid", "uuid", "pos", "b.*")


def raw_transcript(messages: DataFrame) -> DataFrame:
    """(conv_uuid, raw): the raw messages of each conversation, in order, as a JSON array."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "raw")))
    return messages.groupBy("conv_uuid").agg(rows.alias("r")).select("conv_uuid", F.concat(F.lit("["), F.array_join("r.raw", ","), F.lit("]")).alias("raw"))


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(F.format_number(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / 1024**2, 1), F.lit(" MB")))


def attachments(messages: DataFrame) -> DataFrame:
    """(conv_uuid, uuid, name, size, body, more): attachments with text, and how many characters the body leaves out;
    files without content have only a name."""
    a = F.col("a")
    told = messages.select("conv_uuid", "uuid", F.explode(raw_array(F.col("raw"), "$.attachments")).alias("a")).filter(is_object(a))
    text = F.coalesce(member(a, "extracted_content"), F.lit(""))
    name = lambda *names: F.coalesce(*[F.nullif(member(a, n), F.lit("")) for n in names])
    full = told.select("conv_uuid", "uuid", F.coalesce(name("file_name"), F.lit("document")).alias("name"), human_size(member(a, "file_size").try_cast("bigint")).alias("size"), F.substring(text, 1, ATTACHMENT_CHARS).alias("body"), F.greatest(F.length(text) - ATTACHMENT_CHARS, F.lit(0)).alias("more"))
    files = messages.select("conv_uuid", "uuid", F.explode(raw_array(F.col("raw"), "$.files")).alias("a"))
    bare = files.select("conv_uuid", "uuid", F.when(is_object(a), name("file_name", "name", "title")).otherwise(a).alias("name")).filter("name is not null")
    return full.unionByName(bare.withColumns({"size": F.lit(None).cast("string"), "body": F.lit(None).cast("string"), "more": F.lit(0)}))
