"""Ordered-line segmentation of statutes into articles and paragraphs.

A document may be far larger than a task, so lines are grouped into blocks of pages:

1. every block reports its marker lines (articles, paragraphs, sections, split markers);
2. the state a block starts with (pending bare marker, article, paragraph, inside or
   outside an article) is carried from block to block over narrow block rows only;
3. lines of all blocks are assigned and assembled independently, with that start state.

Text is shuffled once by block and once, already joined per block, by segment.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.functions.text import matches, strip
from lexiframe.operators.lines import (
    Rules,
    classified_lines,
    per_section,
    split_lines,
    trim_pages,
)
from lexiframe.session import checkpointed

DOC = ["doc_id", "section"]
BLOCK = [*DOC, "block"]
PAGES_PER_BLOCK = 64
OPEN_BLOCKS = 256  # of one span that are folded in a row; longer ones are followed by pointers


def statute_lines(
    pages: DataFrame, rules: dict[str, Rules], pages_per_block: int = PAGES_PER_BLOCK
) -> DataFrame:
    """Classified lines of pages(doc_id, section, page_no, text), without skipped ones."""
    if "lines" not in pages.columns:
        pages = split_lines(pages)
    lines = classified_lines(trim_pages(pages, rules), rules)
    return (
        lines.where("line_class <> 'skip'")
        .withColumn("pos", F.shiftleft(F.col("page_no").cast("bigint"), 32) + F.col("line_no"))
        .withColumn("block", F.floor(F.col("page_no") / pages_per_block))
    )


def _plain(line_class: Column) -> Column:
    """Bare markers and every line no marker pattern above them claimed."""
    return line_class.isin("bare", "paragraph", "text")


def _after_bare(lines: DataFrame) -> DataFrame:
    """Whether the previous plain line is a bare marker; null for a block's first plain line."""
    before = (
        Window.partitionBy(*BLOCK).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    is_bare = F.when(_plain(F.col("line_class")), F.col("line_class") == "bare")
    return lines.withColumn("after_bare", F.last(is_bare, True).over(before))


def _block_events(lines: DataFrame) -> DataFrame:
    """One row per block: marker events in order and whether it ends after a bare marker."""
    cls = F.col("line_class")
    maybe_after_bare = F.coalesce(F.col("after_bare"), F.lit(True))
    surely_after_bare = F.coalesce(F.col("after_bare"), F.lit(False))
    kind = (
        F.when(cls == "article", "A")
        .when(cls == "section", "S")
        .when((cls == "paragraph") & ~surely_after_bare, "P")
        .when((cls == "text") & F.col("number").isNotNull() & maybe_after_bare, "N")
    )
    event = F.struct("pos", kind.alias("kind"), "number", F.isnull("after_bare").alias("first"))
    plain_pos = F.when(_plain(cls), F.col("pos"))
    return lines.groupBy(*BLOCK).agg(
        F.sort_array(F.collect_list(F.when(kind.isNotNull(), event))).alias("events"),
        F.max_by(cls == "bare", plain_pos).alias("ends_bare"),
    )


def _before_block():
    return Window.partitionBy(*DOC).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _successors(events: Column, start: Column) -> Column:
    """Greedy run of consecutive numbers: resets set the number, others must be one more.

    events: array of (pos, reset, number).  Result: last number and accepted positions.
    """
    return F.aggregate(
        events,
        F.struct(start.alias("cur"), F.array().cast("array<bigint>").alias("kept")),
        lambda acc, e: F.when(
            e["reset"] | (e["number"] == acc["cur"] + 1),
            F.struct(
                e["number"].alias("cur"), F.array_append(acc["kept"], e["pos"]).alias("kept")
            ),
        ).otherwise(acc),
    )


def _jumps(numbers: Column) -> Column:
    """Effect of reset-free numbers on an unknown start: map of start -> end, rest unchanged."""
    empty = F.create_map().cast("map<bigint,bigint>")
    return F.aggregate(
        F.reverse(numbers),
        empty,
        lambda m, n: F.map_concat(
            F.map_filter(m, lambda k, _: k != n - 1),
            F.create_map(n - 1, F.coalesce(F.try_element_at(m, n), n)),
        ),
    )


def _start_numbers(
    blocks: DataFrame, runs: str, name: str, carried: dict[str, Column] | None = None
) -> DataFrame:
    """Number every block starts with, as (doc_id, section, block, name), plus ``carried``
    window expressions over the earlier blocks.

    A block with a reset ends on a number of its own.  Between two such blocks only the
    jumps of reset-free blocks matter, so the ordered fold runs over those few rows.
    """
    events = F.col(runs)
    resets = F.filter(events, lambda e: e["reset"])
    has_reset = F.size(resets) > 0
    open_numbers = F.when(
        ~has_reset, _jumps(F.transform(events, lambda e: e["number"]))
    ).otherwise(F.create_map().cast("map<bigint,bigint>"))
    # from the last reset on, the start value no longer matters
    ended = F.when(has_reset, _successors(events, F.lit(0).cast("bigint"))["cur"])
    carried = carried or {}
    others = [c for c in blocks.columns if c not in (*BLOCK, "events", "runs")]
    narrow = blocks.select(*BLOCK, *others, ended.alias("ended"), open_numbers.alias("jumps"))
    before = _before_block()
    base = F.coalesce(F.last("ended", True).over(before), F.lit(0).cast("bigint"))
    spans = narrow.withColumns(
        {"span": F.count("ended").over(before), "base": base, **carried}
    )
    moving = checkpointed(spans.where(F.size("jumps") > 0).select(*BLOCK, "span", "base", "jumps"), "moving")
    long = moving.groupBy(*DOC, "span").count().where(F.col("count") > OPEN_BLOCKS)
    long = checkpointed(long.select(*(F.col(c).alias(f"_{c}") for c in (*DOC, "span"))), "long")
    in_long = _same([*DOC, "span"])
    short = moving.join(long, in_long, "left_anti")
    trail = short.groupBy(*DOC, "span").agg(
        F.first("base").alias("base"),
        F.sort_array(F.collect_list(F.struct("block", F.map_entries("jumps").alias("j")))).alias(
            "steps"
        ),
    )
    after = F.aggregate(
        "steps",
        F.struct(
            F.col("base").alias("cur"),
            F.array().cast("array<struct<block:bigint,number:bigint>>").alias("out"),
        ),
        lambda acc, s: F.struct(
            _follow(acc["cur"], s["j"]).alias("cur"),
            F.array_append(
                acc["out"],
                F.struct(
                    s["block"].alias("block"), _follow(acc["cur"], s["j"]).alias("number")
                ),
            ).alias("out"),
        ),
    )
    moved = trail.select(*DOC, F.explode(after["out"]).alias("o")).select(
        *DOC, F.col("o.block").alias("block"), F.col("o.number").alias("moved")
    )
    if not long.isEmpty():
        moved = moved.unionByName(_followed(moving.join(long, in_long, "left_semi")))
    within = (
        Window.partitionBy(*DOC, "span")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return spans.join(moved, BLOCK, "left").select(
        *BLOCK,
        *carried,
        F.coalesce(F.last("moved", True).over(within), F.col("base")).alias(name),
    )


def _same(columns: list[str], prefix: str = "_") -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return same


def _followed(moving: DataFrame) -> DataFrame:
    """``doc_id, section, block, moved``: number after each block that changes it, for spans of any length.

    A jump of a block leads to the first later block that has a jump from where it ended; the span's
    base leads to the first block with a jump from there.  The jumps taken are those reached from the
    base along these pointers.  Pointers are doubled, so a span of n blocks takes log2(n) rounds of
    joins over narrow rows, and no row or group holds a span.
    """
    span = [*DOC, "span"]
    jumps = moving.select(*span, "block", F.explode("jumps").alias("key", "value"))
    bases = moving.groupBy(*span).agg((F.min("block") - 1).alias("block"), F.first("base").alias("value"))
    nodes = jumps.unionByName(bases.withColumn("key", F.lit(None).cast("bigint")))
    nodes = checkpointed(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    ends = nodes.select(*span, F.col("value").alias("number"), "block", "id", F.lit(False).alias("begins"))
    starts = nodes.where("key is not null").select(*span, F.col("key").alias("number"), "block", "id", F.lit(True).alias("begins"))
    later = Window.partitionBy(*span, "number").orderBy("block").rangeBetween(1, Window.unboundedFollowing)
    begin = F.when(F.col("begins"), F.struct("block", "id"))
    pointers = ends.unionByName(starts).withColumn("to", F.min(begin).over(later)["id"])
    jump = checkpointed(pointers.where("not begins and to is not null").select("id", "to"), "pointers")
    reached = nodes.where("key is null").select("id")
    while not jump.isEmpty():
        more = reached.join(jump, "id").select(F.col("to").alias("id"))
        reached = checkpointed(reached.unionByName(more), "reached")
        onward = jump.select(F.col("id").alias("to"), F.col("to").alias("next"))
        jump = checkpointed(jump.join(onward, "to").select("id", F.col("next").alias("to")), "pointers")
    taken = nodes.where("key is not null").join(reached, "id")
    return taken.select(*BLOCK, F.col("value").alias("moved"))


def _follow(cur: Column, entries: Column) -> Column:
    return F.coalesce(F.try_element_at(F.map_from_entries(entries), cur), cur)


def _runs(events: Column, resets, others) -> Column:
    """(pos, reset, number) view of the events of the given kinds."""
    chosen = F.filter(events, lambda e: e["kind"].isin(*resets, *others))
    return F.transform(
        chosen,
        lambda e: F.struct(
            e["pos"].alias("pos"),
            e["kind"].isin(*resets).alias("reset"),
            F.coalesce(e["number"], F.lit(-1).cast("bigint")).alias("number"),
        ),
    )


def block_markers(lines: DataFrame) -> DataFrame:
    """Resolved markers: one start row per block (pos -1) and one row per accepted marker.

    Columns: occurrence, article, paragraph (0 = none), inside, pending (block start only).
    """
    blocks = checkpointed(_block_events(_after_bare(lines)))

    # 1. Was a bare marker pending when the block began?
    pending = blocks.select(
        *BLOCK,
        F.coalesce(F.last("ends_bare", True).over(_before_block()), F.lit(False)).alias("pending"),
    )
    blocks = blocks.join(pending, BLOCK)
    settled = F.filter(
        "events",
        lambda e: ~e["first"]
        | F.when(e["kind"] == "N", F.col("pending"))
        .when(e["kind"] == "P", ~F.col("pending"))
        .otherwise(True),
    )
    blocks = blocks.withColumn("events", settled).drop("ends_bare")

    # 2. Accepted article markers.
    blocks = blocks.withColumn("runs", _runs(F.col("events"), ["A"], ["N"]))
    blocks = blocks.join(_start_numbers(blocks, "runs", "start_article"), BLOCK)
    blocks = blocks.withColumn(
        "accepted", _successors(F.col("runs"), F.col("start_article"))["kept"]
    )
    opened = F.filter(
        "events",
        lambda e: (e["kind"] != "N") | F.array_contains(F.col("accepted"), e["pos"]),
    )
    blocks = blocks.withColumn(
        "events",
        F.transform(
            opened,
            lambda e: F.struct(
                e["pos"].alias("pos"),
                F.when(e["kind"] == "N", "A").otherwise(e["kind"]).alias("kind"),
                e["number"].alias("number"),
            ),
        ),
    ).drop("runs", "accepted")
    blocks = checkpointed(blocks)  # marker rows only; keeps step 3 from repeating step 2

    # 3. Accepted paragraph markers: every article restarts the count at zero.
    restarts = F.transform(
        "events",
        lambda e: F.struct(
            e["pos"].alias("pos"),
            e["kind"].alias("kind"),
            F.when(e["kind"] == "A", F.lit(0).cast("bigint")).otherwise(e["number"]).alias("number"),
        ),
    )
    blocks = blocks.withColumn("runs", _runs(restarts, ["A"], ["P"]))
    edges = F.filter("events", lambda e: e["kind"].isin("A", "S"))
    blocks = blocks.withColumn(
        "articles", F.size(F.filter("events", lambda e: e["kind"] == "A"))
    ).withColumn("last_edge", F.try_element_at(edges, F.lit(-1))["kind"])
    before = _before_block()
    carried = {
        "start_occurrence": F.coalesce(F.sum("articles").over(before), F.lit(0)),
        "start_inside": F.coalesce(F.last("last_edge", True).over(before), F.lit("S")) == "A",
    }
    starts = _start_numbers(blocks, "runs", "start_paragraph", carried)
    blocks = blocks.join(starts, BLOCK).withColumn(
        "accepted", _successors(F.col("runs"), F.col("start_paragraph"))["kept"]
    )
    return _marker_rows(blocks)


def _marker_rows(blocks: DataFrame) -> DataFrame:
    start = F.struct(
        F.lit(-1).cast("bigint").alias("pos"),
        F.lit("B").alias("kind"),
        F.lit(None).cast("bigint").alias("number"),
    )
    kept = F.filter(
        "events",
        lambda e: (e["kind"] != "P") | F.array_contains(F.col("accepted"), e["pos"]),
    )
    rows = blocks.select(
        *BLOCK,
        "pending",
        "start_article",
        "start_paragraph",
        "start_occurrence",
        "start_inside",
        F.explode(F.concat(F.array(start), kept)).alias("e"),
    )
    kind, number = F.col("e.kind"), F.col("e.number")
    upto = Window.partitionBy(*BLOCK).orderBy("e.pos")
    return rows.select(
        *BLOCK,
        F.col("e.pos").alias("pos"),
        kind.alias("kind"),
        F.when(kind == "B", F.col("pending")).alias("pending"),
        (F.col("start_occurrence") + F.sum((kind == "A").cast("bigint")).over(upto)).alias(
            "occurrence"
        ),
        F.when(kind == "A", number).when(kind == "B", F.col("start_article")).alias("article"),
        F.when(kind == "A", F.lit(0).cast("bigint"))
        .when(kind == "P", number)
        .when(kind == "B", F.col("start_paragraph"))
        .alias("paragraph"),
        F.when(kind == "A", True)
        .when(kind == "S", False)
        .when(kind == "B", F.col("start_inside"))
        .alias("inside"),
    )


def segment(
    pages: DataFrame,
    rules: dict[str, Rules],
    pages_per_block: int = PAGES_PER_BLOCK,
) -> DataFrame:
    """Segments of pages(doc_id, section, page_no, text or lines).

    Output: doc_id, section, occurrence (order of the article in its document),
    article_number, paragraph_number (null when the article has none), text.
    """
    lines = statute_lines(pages, rules, pages_per_block).select(*BLOCK, "pos", "line_class", "number", "text")
    lines = checkpointed(lines, "lines")  # markers and text are read apart; pages are split and classified once
    markers = _with_numbered(checkpointed(block_markers(lines), "markers"))
    assigned = _assign(lines, markers, rules)

    separated = F.concat(F.when(F.col("is_list"), "\n").otherwise(" "), F.col("text"))
    keys = [*DOC, "occurrence", "article", "paragraph"]

    def joined(col):
        return F.array_join(F.transform(F.sort_array(F.collect_list(col)), lambda x: x["s"]), "")

    fragments = assigned.groupBy(*BLOCK, "occurrence", "article", "paragraph").agg(
        joined(F.struct("pos", separated.alias("s"))).alias("s")
    )
    segments = fragments.groupBy(*keys).agg(joined(F.struct("block", "s")).alias("s"))
    return (
        segments.withColumn("text", strip(F.col("s")))
        .where("text <> ''")
        .select(
            *DOC,
            "occurrence",
            F.col("article").alias("article_number"),
            F.expr("nullif(paragraph, 0)").alias("paragraph_number"),
            "text",
        )
    )


def _with_numbered(markers: DataFrame) -> DataFrame:
    """Flag markers of articles with numbered paragraphs: text ahead of those is dropped."""
    article = [*DOC, "occurrence"]
    numbered = markers.where("kind = 'P'").select(*article).distinct()
    return markers.join(numbered.withColumn("numbered", F.lit(True)), article, "left").fillna(
        False, ["numbered"]
    )


def _assign(lines: DataFrame, markers: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    """Text lines with the article and paragraph they belong to."""
    plain = lines.where(_plain(F.col("line_class"))).select(*BLOCK, "pos", "line_class", "text")
    stacked = plain.unionByName(markers, allowMissingColumns=True)
    order = Window.partitionBy(*BLOCK).orderBy("pos", F.col("kind").isNull())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    states = {
        c: F.last(c, True).over(upto)
        for c in ("pending", "occurrence", "article", "paragraph", "inside", "numbered")
    }
    states["marker_pos"] = F.last(F.when(F.col("kind").isNotNull(), F.col("pos")), True).over(upto)
    states["after_bare"] = F.last(F.col("line_class") == "bare", True).over(before)
    placed = stacked.withColumns(states).where(
        F.col("kind").isNull()
        & (F.col("line_class") != "bare")
        & F.col("inside")
        & ((F.col("paragraph") > 0) | ~F.col("numbered"))
        & (F.col("marker_pos") != F.col("pos"))
    )
    split = F.coalesce("after_bare", "pending")
    prefixed = F.concat(F.lit(f"{fixed.ARTICLE_WORD} "), F.col("text"))
    return (
        placed.where(split | (F.col("line_class") != "paragraph"))
        .withColumn("text", F.when(split, prefixed).otherwise(F.col("text")))
        .withColumn("is_list", per_section(rules, lambda r: matches(F.col("text"), r.ordered_list)))
    )
