"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.ranking import global_rank
from bitloom.plans.storage import materialize

# golden ratio as an odd step modulo 2**31: slot n gets the point frac(n * 0.618...) in exact integers
PERIOD = 1 << 31
STEP = 1327217885
CELLS = 1 << 12  # cells of the unit interval on which points meet the sources' intervals
WHITE = r"[\x20\x09-\x0D]+"


def words_of(text: Column | str) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")
    return F.size(kept).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    Sources in code-point order, null last, get the ``weights`` in turn. They
    divide ``share`` of all sizes by weight; a target stops at ``most`` times
    its source's size, and the excess is divided again among the others until
    none is above. A round is one aggregation that returns three numbers.
    """
    ranked = global_rank(sizes, [F.col("source").isNull(), F.col("source")], name="_place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    table = materialize(
        ranked.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("_cap")),
        "sources",
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, -1
    while True:
        full = F.col("_cap") <= F.col("weight") * F.lit(level)
        n, capped, open_weight = table.agg(
            F.count_if(full), F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        if n == seen or not open_weight:
            break
        seen, level = n, max(0.0, (share * total - capped) / open_weight)
    target = F.when(full, F.col("_cap")).otherwise(F.col("weight") * F.lit(level))
    return materialize(table.select("source", "source_size", "weight", target.alias("target")), "targets")


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """``slot, source, draw, start, stop``: which words of a source's line every slot takes.

    Slot n of the schedule has the point frac(n·φ); the sources' shares of all
    targets cut the unit interval, and the source whose interval holds the
    point gets the slot. The draws of a source are numbered in order of slot:
    draw k takes the block of words from k·``block`` on, and starts over, in a
    new pass, where the line ends. A source's draws end at its target, the last
    one short; the few draws by which the sequence falls behind a target follow
    after the last slot. ``plan`` has ``source, source_size, target``.
    """
    words = F.floor(F.col("target")).cast("long")
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    passes = F.floor(words / F.col("source_size")).cast("long")
    rest = words - passes * F.col("source_size")
    draws = passes * blocks + F.ceil(rest / F.lit(block)).cast("long")
    wanted = plan.filter("source_size > 0").select("source", "source_size", words.alias("_words"), blocks.alias("_blocks"), draws.alias("_draws"))
    shares = global_rank(wanted.filter("_draws > 0"), [F.col("source").isNull(), F.col("source")], name="_i", running={"_below": "_draws"})
    shares = materialize(shares, "shares")
    total = shares.agg(F.sum("_draws")).first()[0] or 0
    spark = plan.sparkSession
    edge = lambda draws: F.floor(draws.cast("decimal(38,0)") * PERIOD / F.lit(max(total, 1))).cast("long")
    spans = shares.withColumns({"_from": edge(F.col("_below")), "_to": edge(F.col("_below") + F.col("_draws"))})
    cell = PERIOD // CELLS
    spans = spans.filter("_to > _from").withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_from") / cell), F.floor((F.col("_to") - 1) / cell)))
    )
    points = spark.range(total).select(F.col("id").alias("slot"), (F.col("id") % PERIOD * STEP % PERIOD).alias("_point"))
    points = points.withColumn("_cell", F.floor(F.col("_point") / cell))
    hits = points.join(spans, "_cell").filter("_point >= _from and _point < _to").select("slot", "_i")
    ranked = global_rank(hits, [F.col("slot")], ["_i"], "_k").select("_i", (F.col("_k") - 1).alias("draw"), "slot")
    ranked = materialize(ranked, "hits")
    drawn = ranked.groupBy("_i").agg(F.count("*").alias("_n"))
    late = (
        shares.join(drawn, "_i", "left")
        .withColumn("_n", F.coalesce("_n", F.lit(0)))
        .filter("_n < _draws")
        .select("_i", F.explode(F.sequence("_n", F.col("_draws") - 1)).alias("draw"), F.lit(total).alias("slot"))
    )
    every = ranked.unionByName(late).join(shares, "_i").filter("draw < _draws")
    turn = F.floor(F.col("draw") / F.col("_blocks")).cast("long")
    start = F.col("draw") % F.col("_blocks") * block
    before = turn * F.col("source_size") + start
    stop = F.least(start + block, F.col("source_size"), start + F.col("_words") - before)
    return every.select("slot", "source", "draw", turn.alias("turn"), start.alias("start"), stop.alias("stop"))


def mix(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    most: float = 2.0,
    block: int = 512,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row ``id_col, source_col, size, source_size, target, taken, passes, part, slots, n_slots``.

    The rows of a source are shuffled by a seeded hash of id and size and laid
    out as one line of words, cut into blocks of ``block`` words; the schedule
    takes blocks, and ``taken`` adds up the words of a row in all blocks taken.
    ``passes`` whole copies and the first ``part`` words of another make up
    ``taken``; ``slots`` lists, copy by copy, the slot of the schedule in which
    the row's first word is drawn (at most ``most`` + 1 of them; null for rows
    that are not taken), out of ``n_slots``. Nulls: a null text has size 0, rows of the null source form a
    source, rows of equal id and size are interchangeable. Empty tables give an
    empty result. No window or join holds a source in one task: lines are
    positions in a range-partitioned order.
    """
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_of(text_col).alias("size")), "sizes"
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    slots = schedule(plan, block)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    line = global_rank(rows, [order, F.col("id"), F.col("size")], ["source"], "row", running={"at": "size"})
    line = materialize(line, "line")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    most_slots = slots.agg(F.max("slot")).first()[0] or 0
    pieces = line.filter("size > 0").select(
        F.col("source").alias("of"), "row", "at", "size", F.explode(F.sequence(first, last)).alias("_block")
    )
    drawn = slots.groupBy("source", F.floor(F.col("start") / block).alias("_cut"), "start", "stop").agg(
        F.count("*").alias("times"), F.collect_list(F.struct("turn", "slot")).alias("_turns")  # a few passes
    )
    met = F.col("of").eqNullSafe(F.col("source")) & (F.col("_block") == F.col("_cut"))
    overlap = F.least(F.col("stop"), F.col("at") + F.col("size")) - F.greatest(F.col("start"), F.col("at"))
    taken = (
        pieces.join(drawn, met)
        .groupBy("of", "row")
        .agg(
            F.sum(F.greatest(overlap, F.lit(0)) * F.col("times")).alias("taken"),
            F.array_sort(F.flatten(F.collect_list(F.when((F.col("_cut") == F.floor(F.col("at") / block)) & (overlap > 0), F.col("_turns"))))).alias("_turns"),
        )
        .withColumnRenamed("row", "_row")
    )
    same = F.col("of").eqNullSafe(F.col("source")) & (F.col("row") == F.col("_row"))
    whole = line.join(taken, same, "left").drop("of", "_row").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    goal = plan.select(F.col("source").alias("of"), "source_size", "target")
    passes = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    return whole.join(goal, F.col("of").eqNullSafe(F.col("source"))).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        "taken",
        passes.alias("passes"),
        (F.col("taken") - passes * F.col("size")).alias("part"),
        F.when(F.col("taken") > 0, F.col("_turns.slot")).alias("slots"),
        F.lit(most_slots + 1).cast("long").alias("n_slots"),
    )


def drawn_documents(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that `mix` takes: ``passes`` copies of each, and one more with the first ``part`` words.

    The rows lie in the order of the schedule: partitions are spans of slots,
    sorted by slot, so a reader of consecutive rows meets the sources in their
    target shares. A part has its words joined by single spaces. Rows of equal
    id, source and size get the decisions of the plan in order of their text.
    All columns of ``docs`` stay as they are but the text of a part.
    """
    keys = ["_id", "_source", "_size"]
    named = docs.select("*", F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words_of(text_col).alias("_size"))
    same = Window.partitionBy(*keys)
    named = named.withColumn("_twin", F.row_number().over(same.orderBy(text_col)))
    chosen = plan.filter("taken > 0").select(
        F.col(id_col).alias("_i"), F.col(source_col).alias("_s"), F.col("size").alias("_n"), "passes", "part", "slots", "n_slots"
    )
    order = Window.partitionBy("_i", "_s", "_n").orderBy(F.desc("passes"), F.desc("part"))
    chosen = chosen.withColumn("_t", F.row_number().over(order))
    met = F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n"))
    taken = named.join(chosen, met & (F.col("_twin") == F.col("_t")))
    last = F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>"))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("passes").cast("int")), last)
    every = taken.select("*", F.posexplode(copies).alias("_copy", "_words"))
    words = F.filter(F.split(text_col, WHITE), lambda w: w != "")
    text = F.when(F.col("_words") < 0, F.col(text_col)).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), " "))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.coalesce(F.get("slots", F.col("_copy")), F.col("n_slots") - 1)
    span = F.least(F.floor(slot * F.lit(parts) / F.col("n_slots")), F.lit(parts - 1)).cast("int")
    placed = every.withColumn(text_col, text).select(*docs.columns, slot.alias("_slot"), span.alias("_span"), "_copy")
    laid = placed.repartitionById(parts, F.col("_span")).sortWithinPartitions("_slot", F.col(id_col), "_copy")
    return laid.select(*docs.columns)
