"""From raw conversations to typed rows: conversations, messages with prose and tool text, and chunks.

A raw conversation is one JSON text. Objects are read one by one from arrays of raw JSON, so that one malformed element
costs only itself, and unknown members survive in ``raw``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.chunk import MAX_CHARS, chunked
from talkmill.functions.text import content_sha256, head_or_parent, messages_digest, parse_ts, strip

# File types and suffixes of documents that people write, the folder of uploaded files, the numbers that
# the view tool puts before lines, and JSON values that count as no input.
PROSE_TYPES = ["application/pdf", "doc", "docx", "html", "md", "pdf", "rtf", "text/html", "text/markdown", "text/plain", "txt"]
PROSE_SUFFIXES = [".doc", ".docx", ".htm", ".html", ".md", ".pdf", ".rtf", ".txt"]
UPLOADS = "/mnt/user-data/uploads/"
LINE_NUMBER = r"(?m)^ *\d+\t"
NO_INPUT = ["", "{}", "[]", "0", "false", "null"]
#: Least characters of a text that is worth a vector.
LEAST_CHARS = 12

EMPTY = "array<string>"
#: What is read of a content block and of an attachment, at once; members that are objects or lists come as their JSON.
BLOCK = "struct<type:string,text:string,id:string,name:string,tool_use_id:string,is_error:string,input:string,content:variant>"
ITEM = "struct<title:string,text:string,url:string,metadata:struct<site_name:string>>"
ATTACHMENT = "struct<file_name:string,file_type:string,extracted_content:string>"


def raw_array(json: Column, path: str | None = None) -> Column:
    """The elements of a JSON array as raw JSON texts; an empty array for anything else."""
    source = F.get_json_object(json, path) if path else json
    return F.coalesce(F.from_json(source, EMPTY), F.array().cast(EMPTY))


def member(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")


def is_object(json: Column) -> Column:
    return F.coalesce(json.startswith("{"), F.lit(False))


def joined(parts: Column, ends: Callable[[Column], Column] = strip) -> Column:
    """Non-empty parts with line ends between them, stripped."""
    return ends(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n"))


def conversations(raw: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Metadata of each raw conversation (``raw``): empty names and summaries are null; n_messages counts all messages.

    Rows without a uuid are left out; ``rejected`` has them. With ``keep_raw`` the raw text stays.
    """
    r = F.col("raw")
    messages = raw_array(r, "$.chat_messages")
    return raw.filter(member(r, "uuid").isNotNull()).select(
        member(r, "uuid").alias("uuid"),
        F.nullif(member(r, "name"), F.lit("")).alias("name"),
        F.nullif(member(r, "summary"), F.lit("")).alias("summary"),
        parse_ts(member(r, "created_at")).alias("created_at"),
        parse_ts(member(r, "updated_at")).alias("updated_at"),
        F.get_json_object(r, "$.account.uuid").alias("account_uuid"),
        F.size(messages).alias("n_messages"),
        messages_digest(messages).alias("source_sha256"),
        *["raw"] * keep_raw,
    )


def rejected(raw: DataFrame) -> DataFrame:
    return raw.filter(member(F.col("raw"), "uuid").isNull())


def basename(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1), F.lit("")), F.lit("uploaded-file"))


def upload_views(messages: Column) -> Column:
    """(id, name) of the tool calls of a conversation that view an uploaded file; of equal ids the last one comes last."""
    # only blocks whose text names the folder are read
    blocks = F.flatten(F.transform(F.filter(messages, lambda m: F.contains(m, F.lit(UPLOADS))), lambda m: F.filter(raw_array(m, "$.content"), lambda b: is_object(b) & F.contains(b, F.lit(UPLOADS)))))
    read = F.transform(blocks, lambda b: F.from_json(b, "type string, name string, id string, input struct<path:string,file_path:string>"))
    path = lambda b: F.coalesce(b["input"]["path"], b["input"]["file_path"])
    views = F.filter(read, lambda b: (b["type"] == "tool_use") & (b["name"] == "view") & F.coalesce(F.contains(path(b), F.lit(UPLOADS)), F.lit(False)))
    return F.transform(views, lambda b: F.named_struct(F.lit("id"), b["id"], F.lit("name"), basename(path(b))))


def explode_messages(raw: DataFrame) -> DataFrame:
    """(conv_uuid, seq, uuid, parent_uuid, sender, created_at, raw, views): a row for each message of a conversation.

    A message without uuid is named by its conversation and position. The names of viewed uploads travel with each row,
    so no join is needed to find them.
    """
    own = raw.filter(member(F.col("raw"), "uuid").isNotNull()).select(member(F.col("raw"), "uuid").alias("conv_uuid"), raw_array(F.col("raw"), "$.chat_messages").alias("ms"))
    rows = own.select("conv_uuid", upload_views(F.col("ms")).alias("views"), F.posexplode("ms").alias("seq", "raw"))
    m = F.col("raw")
    return rows.select(
        "conv_uuid",
        "seq",
        F.coalesce(F.nullif(member(m, "uuid"), F.lit("")), F.concat_ws(":", "conv_uuid", F.col("seq").cast("string"))).alias("uuid"),
        head_or_parent(member(m, "parent_message_uuid")).alias("parent_uuid"),
        member(m, "sender").alias("sender"),
        parse_ts(member(m, "created_at")).alias("created_at"),
        "raw",
        "views",
    )


def spaced(json: Column) -> Column:
    """Compact JSON text with a space after each comma and colon that stands outside of strings."""
    # no JSON text holds control characters, so two of them can stand for what is escaped while quotes are looked for
    kept = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    told = F.transform(F.split(kept, '"', -1), lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, r"([,:])(?!\s)", "$1 ")).otherwise(x))
    return F.replace(F.replace(F.array_join(told, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def item_text(x: Column) -> Column:
    """Title, text, and site name or else address of a result's item, given as JSON."""
    read = F.from_json(x, ITEM)
    return F.get(F.transform(F.array(read), lambda r: F.concat_ws("\n", F.nullif(r["title"], F.lit("")), F.nullif(r["text"], F.lit("")), F.coalesce(F.nullif(r["metadata"]["site_name"], F.lit("")), F.nullif(r["url"], F.lit(""))))), F.lit(0))


def tool_result_text(content: Column) -> Column:
    """The text of a result's content, a variant: of the items of a list, of one object, or a plain text as it is."""
    kind = F.schema_of_variant(content)
    whole = F.to_json(content)
    items = F.transform(raw_array(whole), lambda x: F.when(is_object(x), item_text(x)).otherwise(x))
    as_list = F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), "\n")
    plain = F.coalesce(F.try_variant_get(content, "$", "string"), F.lit(""))
    return F.when(F.coalesce(kind.startswith("ARRAY"), F.lit(False)), as_list).when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), item_text(whole)).otherwise(plain)


def attachment_text(x: Column) -> Column:
    """(prose, text) of an attachment with its label, without white space around it; null for a blank one."""

    def told(a: Column) -> Column:
        name = F.coalesce(F.nullif(a["file_name"], F.lit("")), F.lit("document"))
        body = strip(F.coalesce(a["extracted_content"], F.lit("")))
        prose = F.coalesce(F.lower(a["file_type"]).isin(*PROSE_TYPES), F.lit(False))
        for suffix in PROSE_SUFFIXES:
            prose = prose | F.lower(name).endswith(suffix)
        return F.when(body != "", F.named_struct(F.lit("prose"), prose, F.lit("text"), F.concat(F.lit("[attachment: "), name, F.lit("]\n"), body)))

    return F.when(is_object(x), F.get(F.transform(F.array(F.from_json(x, ATTACHMENT)), told), F.lit(0)))


def block_text(x: Column, views: Column) -> Column:
    """(prose, text) of a content block; null for thinking, budgets, flags, images and anything unknown."""
    part = lambda prose, text: F.named_struct(F.lit("prose"), F.lit(prose), F.lit("text"), text)

    def result(b: Column) -> Column:
        mine = F.filter(views, lambda v: v["id"] == b["tool_use_id"])

        def told(text: Column) -> Column:
            viewed = (F.size(mine) > 0) & (text != "") & ~F.coalesce(b["is_error"] == "true", F.lit(False))
            upload = F.concat(F.lit("[uploaded file: "), F.element_at(mine, -1)["name"], F.lit("]\n"), F.regexp_replace(text, LINE_NUMBER, ""))
            return F.when(viewed, part(True, upload)).otherwise(part(False, text))

        # one-element arrays bind what is read, so that it is read once
        return F.get(F.transform(F.array(tool_result_text(b["content"])), told), F.lit(0))

    def told(b: Column) -> Column:
        call = F.concat_ws("\n", F.nullif(b["name"], F.lit("")), F.when(~b["input"].isin(*NO_INPUT), spaced(b["input"])))
        return F.when(b["type"] == "text", part(True, b["text"])).when(b["type"] == "tool_use", part(False, call)).when(b["type"] == "tool_result", result(b))

    return F.when(is_object(x), F.get(F.transform(F.array(F.from_json(x, BLOCK)), told), F.lit(0)))


def message_texts(messages: DataFrame, ends: Callable[[Column], Column] = strip) -> DataFrame:
    """Messages with ``text`` (prose, '' if none) and ``tool_text`` (null if none), in the order of their blocks.

    ``ends`` takes from both ends of a message's texts what doesn't count there.
    """
    blocks = F.transform(raw_array(F.col("raw"), "$.content"), lambda b: block_text(b, F.col("views")))
    attached = F.transform(raw_array(F.col("raw"), "$.attachments"), attachment_text)
    parts = messages.withColumn("parts", F.filter(F.concat(blocks, attached), lambda p: p.isNotNull()))
    of = lambda prose: joined(F.transform(F.filter("parts", lambda p: p["prose"] == prose), lambda p: p["text"]), ends)
    both = parts.withColumns({"text": of(True), "tool_text": of(False)})
    flat = ends(F.coalesce(member(F.col("raw"), "text"), F.lit("")))
    both = both.withColumn("text", F.when((F.col("text") == "") & (F.col("tool_text") == ""), flat).otherwise(F.col("text")))
    return both.withColumn("tool_text", F.nullif("tool_text", F.lit(""))).drop("parts", "views")


def derive_chunks(messages: DataFrame, least: int = LEAST_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """Chunks of the prose of each message that has at least ``least`` characters, with sender, date and hash."""
    rows = messages.filter(F.length(strip(F.col("text"))) >= least)
    pieces = rows.select(F.col("uuid").alias("msg_uuid"), "conv_uuid", "sender", "created_at", F.posexplode(chunked(F.col("text"), most)).alias("seq", "text"))
    return pieces.withColumn("text_sha256", content_sha256(F.col("text")))
