"""Operator 10: chat formatting by quotation linking.

Lines that begin with ``>`` marks are quotes, the number of marks their level.
Every own line of a message is hashed in normal form (no quote marks, white
space collapsed, case folded), and so is every quoted line.  Quoted lines of
one level in a row are a passage.  A passage that an earlier message of the
conversation holds as consecutive lines counts as one unit, any other as its
single lines; a message replies to the earlier message that says most quoted
lines in units of its outermost linked quote, the nearest one on ties.  Replies
are ordered below what they reply to, and the quotes are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealflow.llm.common import byte_list, materialize, slices

BLOCK_BITS, BLOCK_LEVELS = 10, 3  # turns are searched in blocks of 2 ** 10, up to three times nested
_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_WROTE = re.compile(r"\b(?:wrote|writes|schrieb|écrit|escribió)\Z")


def is_attribution(line: str) -> bool:
    """Whether a line of any length introduces a quote: "... wrote:"."""
    head, colon, rest = line.rpartition(":")
    return bool(colon) and ">" not in line and not rest.strip(" \t") and bool(_WROTE.search(head.rstrip(" \t")[-20:]))


def parse_quotes(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """Own text without quotes and attribution lines; (level, lines) of each quoted passage."""
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    inside = False
    for line in text.split("\n"):
        if m := _MARKS.match(line):
            if own and is_attribution(own[-1]):
                own.pop()  # "... wrote:" before a quote belongs to it
            level = m[1].count(">")
            if not (inside and quoted[-1][0] == level):
                quoted.append((level, []))
            quoted[-1][1].append(line[m.end():])
            inside = True
        else:
            own.append(line)
            inside = False
    return "\n".join(own).strip("\n") if quoted else text, quoted


def normal_form(line: str) -> str:
    return " ".join(line.split()).casefold()


def line_hash(line: str) -> bytes | None:
    """Hash of a line's normal form; null for a blank line."""
    form = normal_form(line)
    return xxhash.xxh3_128_digest(form.encode()) if form else None


def passage_hash(lines: list[bytes]) -> bytes:
    """Hash of a passage from its lines' hashes; a single line's is its own."""
    return lines[0] if len(lines) == 1 else xxhash.xxh3_128_digest(b"".join(lines))


def _parsed(messages: DataFrame) -> DataFrame:
    passage = pa.list_(pa.struct([("level", pa.int32()), ("lines", pa.list_(pa.binary())), ("key", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            parts = [parse_quotes(t.decode()) for t in byte_list(b.column("text"))]
            said = [[h for x in own.split("\n") if (h := line_hash(x))] for own, _ in parts]
            quoted = [[{"level": n, "lines": hs, "key": passage_hash(hs)} for n, q in qs
                       if (hs := [h for x in q if (h := line_hash(x))])] for _, qs in parts]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("role"),
                 pa.array([own for own, _ in parts], pa.string()), pa.array(said, pa.list_(pa.binary())),
                 pa.array(quoted, passage)],
                ["conv_id", "turn", "role", "text", "said", "quoted"])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, said array<binary>, quoted "
                                "array<struct<level:int,lines:array<binary>,key:binary>>").withColumn(
        "row", F.monotonically_increasing_id())


def _sayers(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv_id, key, turn), distinct: the messages that hold passages of ``wanted``.

    ``wanted``: conv_id, first (line), size, distinct.  Only places where a
    passage's first line is said are looked at, so no other runs of lines are made.
    """
    at = parsed.where("conv_id is not null and turn is not null").select(
        "row", "conv_id", "turn", F.size("said").alias("n"), F.posexplode("said").alias("place", "first"))
    hits = at.join(wanted, ["conv_id", "first"]).where("place + size <= n")
    single = hits.where("size = 1").select("conv_id", F.col("first").alias("key"), "turn")
    runs_at = hits.where("size > 1").groupBy("row").agg(F.collect_list(F.struct("place", "size")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [list({passage_hash(said[r["place"]:r["place"] + r["size"]]) for r in runs})
                    for said, runs in zip(b.column("said").to_pylist(), b.column("runs").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), pa.array(keys, pa.list_(pa.binary()))],
                ["conv_id", "turn", "keys"])

    longer = parsed.select("row", "conv_id", "turn", "said").join(runs_at, "row").drop("row").mapInArrow(
        run, "conv_id long, turn long, keys array<binary>").select("conv_id", F.explode("keys").alias("key"), "turn")
    return single.unionByName(longer).distinct()


def _nearest(sayers: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (conv_id, key, turn) with ``parent``, the last sayer before the turn; only if there is one.

    Turns are looked through in blocks, then blocks in blocks of blocks, so that
    a line that a whole long conversation says and quotes spreads over tasks.
    """
    says = sayers.select("conv_id", "key", F.col("turn").alias("t"), F.col("turn").alias("parent"))
    asks = asked.select("conv_id", "key", F.col("turn").alias("t"), "turn")
    found = None
    for level in range(BLOCK_LEVELS + 1):
        block = F.shiftright("t", BLOCK_BITS)
        group = ["conv_id", "key"] + (["block"] if level < BLOCK_LEVELS else [])
        both = says.withColumn("turn", F.lit(None).cast("long")).unionByName(
            asks.withColumn("parent", F.lit(None).cast("long"))).withColumn("block", block)
        before = Window.partitionBy(*group).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
        seen = both.withColumn("parent", F.max("parent").over(before)).where("turn is not null")
        hit = seen.where("parent is not null").select("conv_id", "key", "turn", "parent")
        found = hit if found is None else found.unionByName(hit)
        if level < BLOCK_LEVELS:
            asks = seen.where("parent is null").select("conv_id", "key", F.col("block").alias("t"), "turn")
            says = says.groupBy("conv_id", "key", block.alias("t")).agg(F.max("parent").alias("parent"))
    return found


def reply_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): which earlier turn a message with quotes replies to.

    Among a message's quotes the lowest level that links counts; the message
    that says most lines in units (passages that some earlier message holds,
    lines of other passages) wins, then the later turn.  All earlier sayers of
    all units count.  Sayers of a message's most common unit are not listed: one
    that says no other unit can only win as the last of them.
    """
    quotes = materialize(parsed.where("size(quoted) > 0 and conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.key", "q.lines").groupBy(
        "conv_id", "turn", "level", "key").agg(F.count("*").alias("n"), F.any_value("lines").alias("lines")), "quotes")
    lines = quotes.where("size(lines) > 1").select(
        "conv_id", "turn", "level", F.col("key").alias("of"), "n", F.explode("lines").alias("key"))
    wanted = quotes.select("conv_id", F.col("lines")[0].alias("first"), F.size("lines").alias("size")).unionByName(
        lines.select("conv_id", F.col("key").alias("first"), F.lit(1).alias("size"))).distinct()
    sayers = materialize(_sayers(parsed, wanted), "sayers")
    asked = quotes.select("conv_id", "key", "turn").unionByName(lines.select("conv_id", "key", "turn")).distinct()
    near = materialize(_nearest(sayers, asked), "nearest")
    place = ["conv_id", "turn", "level"]
    whole = quotes.join(near, ["conv_id", "key", "turn"], "left_semi")
    units = whole.select(*place, "key", (F.col("n") * F.size("lines")).alias("n")).unionByName(
        lines.join(whole.select(*place, F.col("key").alias("of")), [*place, "of"], "left_anti").select(*place, "key", "n"))
    units = units.groupBy(*place, "key").agg(F.sum("n").alias("n")).join(near, ["conv_id", "key", "turn"]).join(
        sayers.groupBy("conv_id", "key").agg(F.count("*").alias("common")), ["conv_id", "key"])
    message = Window.partitionBy("conv_id", "turn")
    units = units.withColumn("lowest", F.min("level").over(message)).where("level = lowest").withColumn(
        "rank", F.row_number().over(message.orderBy(F.desc("common"), "key")))
    units = materialize(units.select("conv_id", "turn", "key", "n", "parent", "rank"), "units")
    most = units.where("rank = 1")
    votes = units.where("rank > 1").select("conv_id", "turn", "key", "n").join(
        sayers.withColumnRenamed("turn", "parent"), ["conv_id", "key"]).where("parent < turn").select(
        "conv_id", "turn", "parent", "n").unionByName(
        most.select("conv_id", "turn", "parent", F.lit(0).cast("long").alias("n"))).groupBy(
        "conv_id", "turn", "parent").agg(F.sum("n").alias("n"))
    says = sayers.select("conv_id", "key", F.col("turn").alias("parent"), F.lit(True).alias("says"))
    votes = votes.join(most.select("conv_id", "turn", "key", F.col("n").alias("more")), ["conv_id", "turn"]).join(
        says, ["conv_id", "key", "parent"], "left").withColumn("n", F.col("n") + F.when(F.col("says"), F.col("more")).otherwise(0))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "parent")).alias("b")).select(
        "conv_id", "turn", "b.parent")


def reply_paths(links: DataFrame) -> DataFrame:
    """(conv_id, turn, path): turns from the root down, by doubling."""
    cur = links.select("conv_id", "turn", F.col("parent").alias("up"), F.array("turn").alias("path"))
    while True:
        cur = materialize(cur, "paths")
        if cur.where("up is not null").isEmpty():
            return cur.select("conv_id", "turn", "path")
        above = cur.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"),
                           F.col("path").alias("head"))
        step = cur.join(above, ["conv_id", "up"], "left")
        # a parent without a row of its own is a root
        head = F.when(F.col("up").isNull(), F.array().cast("array<bigint>")).otherwise(
            F.coalesce("head", F.array("up")))
        cur = step.select("conv_id", "turn", F.col("next").alias("up"), F.concat(head, "path").alias("path"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """Every message without its quotes, in reply order within its conversation.

    Columns: conv_id, turn, role, text, parent (null: replies to none), depth,
    order_key (sorting a conversation by it puts each reply below its parent,
    earlier ones first), formatted (role header and text).  Messages with a null
    conv_id or turn link with nothing; rows that repeat a turn all stay and
    share its place.  A null text is empty, a null role "user".  Rows are not
    gathered per conversation: a conversation of any length spreads.
    """
    parsed = materialize(_parsed(messages), "messages")
    links = reply_links(parsed)
    paths = reply_paths(materialize(links, "replies"))
    path = F.coalesce("path", F.array("turn"))
    key = F.array_join(F.transform(path, lambda t: F.lpad((t + F.lit(1 << 62)).cast("string"), 19, "0")), "/")
    role = F.coalesce("role", F.lit("user"))
    return parsed.join(paths, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text",
        F.when(F.size(path) > 1, F.element_at(path, -2)).alias("parent"),
        (F.size(path) - 1).cast("long").alias("depth"), key.alias("order_key"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("text"), F.lit("\n")).alias("formatted"))
