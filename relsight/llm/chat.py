"""Chat formatting of typed content parts with a loss mask, as DataFrame expressions.

A visitor turns each part into a column: text is escaped, every attachment
becomes an ordered placeholder and a record (kind, ordinal, reference,
offset of its turn's body, expanded tokens). Turns are marked by control
strings; control strings inside roles and texts are escaped reversibly, a
placeholder's own string too, so ``read_back`` gets the exact turns again:
their texts, and their parts with what each attachment refers to.

Defined cases: null role, text or part reads as empty; turns are ordered by
(turn, role, content), nulls first; repeated rows stay repeated turns; a null
conversation id is one conversation; a part of no known type is text; texts
that stand side by side in a turn read back as one, empty ones as none; an
empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's own marks and foreign templates' control strings.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
HOLDER = r"<\|(?:image|audio|document)\|>"
#: The first character of each control string, any number of escapes, its rest.
_GUARD = r"(<\\*)(\|(?:turn|body|end|image|audio|document)\|>|/?s>|<SYS>>|</SYS>>)|(\[\\*)(/?INST\])"
_UNGUARD = r"(<\\*)\\(\|(?:turn|body|end|image|audio|document)\|>|/?s>|<SYS>>|</SYS>>)|(\[\\*)\\(/?INST\])"

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    """One more escape in every control string, escaped ones included."""
    return F.regexp_replace(text, F.lit(_GUARD), F.lit(r"$1$3\\$2$4"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNGUARD), F.lit("$1$3$2$4"))


class PartVisitor:
    """What a part becomes: ``text`` (its flattened form) and ``tokens`` (None for text)."""

    def __init__(self, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def visit_text(self, state: Column, part: Column) -> Column:
        return F.struct(state["done"].alias("done"), F.concat(state["open"], F.coalesce(part["text"], F.lit(""))).alias("open"))

    def visit_attachment(self, state: Column, part: Column) -> Column:
        return F.struct(F.concat(state["done"], escape(state["open"]), F.lit("<|"), part["type"], F.lit("|>")).alias("done"), F.lit("").alias("open"))

    def flat(self, parts: Column) -> Column:
        """The body of a turn. Adjacent texts are escaped together, as a control string may span them."""
        none = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
        step = lambda s, p: F.when(self.attached(p), self.visit_attachment(s, p)).otherwise(self.visit_text(s, p))
        return F.aggregate(parts, none, step, lambda s: F.concat(s["done"], escape(s["open"])))

    def attached(self, part: Column) -> Column:
        return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))

    def tokens(self, part: Column) -> Column:
        """Tokens that the placeholder expands to: image patches, audio frames, document pages."""
        side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / self.patch)
        return (
            F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
            .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_rate))
            .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * self.page_tokens)
            .cast("long")
        )


def format_chat(rows: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """(conv_id, turn, role, text or parts) to one formatted row for each conversation.

    Gives conv_id, n_turns, formatted, loss array<struct<start,length>> (code
    points of assistant bodies) and attachments.
    """
    visitor = visitor or PartVisitor()
    if "parts" in rows.columns:
        parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    else:
        one = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *[F.lit(None).alias(x) for x in ("ref", "width", "height", "seconds", "pages")])
        parts = F.array(one).cast(PARTS)
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    turns = turns.withColumn("body", visitor.flat(F.col("parts")))
    found = F.filter("parts", visitor.attached)
    turns = turns.withColumn("found", F.transform(found, lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), visitor.tokens(p).alias("tokens"))))
    turns = turns.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)))
    turns = turns.withColumn("piece", F.struct("turn", "role", "body", "head", "found"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("t"))
    convs = convs.withColumn("sizes", F.transform("t", lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END)))
    convs = convs.withColumn("starts", starts_of(F.col("sizes"))).withColumn("z", F.arrays_zip(F.col("t").alias("t"), F.col("starts").alias("s")))
    body_at = lambda x: x["s"] + F.length(x["t"]["head"])
    loss = F.transform(F.filter("z", lambda x: x["t"]["role"] == "assistant"), lambda x: F.struct(body_at(x).alias("start"), F.length(x["t"]["body"]).alias("length")))
    files = F.flatten(F.transform("z", lambda x: F.transform(x["t"]["found"], lambda f: F.struct(f["kind"].alias("kind"), f["ref"].alias("ref"), body_at(x).alias("body_start"), f["tokens"].alias("tokens")))))
    files = F.transform(files, lambda f, i: F.struct((i + 1).alias("ordinal"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["body_start"].alias("body_start"), f["tokens"].alias("tokens")))
    text = F.concat_ws("", F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))))
    return convs.select("conv_id", F.size("t").cast("long").alias("n_turns"), text.alias("formatted"), loss.alias("loss"), files.alias("attachments"))


def starts_of(sizes: Column, chunk: int = 128) -> Column:
    """Where each of a row of pieces begins, summed a chunk at a time: linear work for any number of turns but enormous ones."""
    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))
    add = lambda a, n: F.struct(F.concat(a["starts"], F.array(a["at"])).alias("starts"), (a["at"] + n).alias("at"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / chunk).cast("int")), lambda c: F.aggregate(F.slice(sizes, c * chunk + 1, F.lit(chunk)), none, add))
    summed = lambda c: F.flatten(F.zip_with(c, F.aggregate(F.transform(c, lambda x: x["at"]), none, add)["starts"], lambda x, at: F.transform(x["starts"], lambda s: s + at)))
    return F.transform(F.array(chunks), summed)[0]


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role,text,parts>> and loss_text, from ``formatted``, its mask and its attachments alone.

    A turn's text has the placeholders of its attachments in it; its parts
    (array<struct<type,text,ref,tokens>>) tell those from texts that look the same.
    """
    marks = lambda x: F.split(x, F.lit(r"\Q" + BODY + r"\E"), 2)
    cut = F.filter(F.split("formatted", r"\Q" + TURN + r"\E"), lambda x: x != "")
    split = F.transform(cut, lambda x: F.struct(marks(x)[0].alias("role"), F.substring(marks(x)[1], F.lit(1), F.length(marks(x)[1]) - len(END)).alias("body")))
    rows = formatted.select("conv_id", "formatted", "loss", "attachments", split.alias("split"))
    sizes = F.transform("split", lambda x: F.length(x["role"]) + F.length(x["body"]) + len(TURN + BODY + END))
    rows = rows.withColumn("starts", starts_of(sizes))
    part = "struct<type:string,text:string,ref:string,tokens:bigint>"

    def parts(body: Column, start: Column) -> Column:
        """Texts between placeholders, and for the k-th placeholder of the turn its k-th attachment."""
        texts = F.transform(F.split(body, HOLDER, -1), lambda x: F.struct(F.lit("text").alias("type"), unescape(x).alias("text"), F.lit(None).alias("ref"), F.lit(None).alias("tokens")).cast(part))
        files = F.transform(F.filter("attachments", lambda a: a["body_start"] == start), lambda a: F.struct(a["kind"].alias("type"), F.lit(None).alias("text"), a["ref"].alias("ref"), a["tokens"].alias("tokens")).cast(part))
        both = F.flatten(F.zip_with(texts, files, lambda t, f: F.array(t, f)))
        return F.filter(both, lambda p: p.isNotNull() & F.coalesce(p["text"] != "", F.lit(True)))

    def turn(x: Column, start: Column) -> Column:
        at = start + len(TURN + BODY) + F.length(x["role"])
        has = F.regexp_like(x["body"], F.lit(HOLDER))
        alone = F.filter(F.array(F.struct(F.lit("text").alias("type"), unescape(x["body"]).alias("text"), F.lit(None).alias("ref"), F.lit(None).alias("tokens")).cast(part)), lambda p: p["text"] != "")
        return F.struct(unescape(x["role"]).alias("role"), unescape(x["body"]).alias("text"), F.when(has, parts(x["body"], at)).otherwise(alone).alias("parts"))

    turns = F.zip_with("split", "starts", turn)
    loss = F.concat_ws("", F.transform("loss", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))))
    return rows.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), loss.alias("loss_text"))
