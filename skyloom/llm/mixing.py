"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves are (domain, lang, source). A budget of tokens goes down the tree by the
weights of siblings; a child that has fewer tokens than its share (its tokens
times the epochs allowed) takes what it has, and its shortage is shared by its
siblings by their weights. What a whole branch can't hold is shared among the
branch's siblings, one level up. Where children are sorted by capacity for a unit
of weight, those that fall short are a prefix, so each level is one window over
siblings.

A leaf's budget is whole epochs of all its documents and a token-prefix of one
more, in the order of md5(seed:epoch:doc_id). The prefix is cut without sorting
a leaf: token sums of about the square root of its rows' number of hash ranges
show the range where the cut falls, and only that range is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SEED = 17
#: How often a document may be used at most.
EPOCHS = 4
LEVELS = ("domain", "leaf_lang", "leaf_source")
#: Domain of a source, here by its number modulo 4 (which its last two digits tell, however long it is); weights by name, all others 1.
DOMAIN = "case when source rlike '^src[0-9]+$' then concat('domain', cast(right(concat('0', substr(source, 4)), 2) as int) % 4) else 'other' end"
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2},
    "leaf_lang": {"en": 5, "de": 2, "fr": 2},
    "leaf_source": {"src0": 2},
}


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level, {})
    value = F.lit(1)
    for name, w in known.items():
        if w < 1:
            raise ValueError("weights are positive whole numbers")
        value = F.when(F.col(level) == name, w).otherwise(value)
    return value.cast("long")


def tokens_of(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def with_leaves(docs: DataFrame, domain: str) -> DataFrame:
    return docs.select("*", F.expr(domain).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("leaf_lang"), F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("leaf_source"))


def share_out(children: DataFrame, parents: list[str], weight: Column) -> DataFrame:
    """Adds budget to children (capacity, tokens; of_parent: the parent's budget): whole tokens, at most the capacity."""
    rows = children.withColumn("weight", weight).withColumn("filled_at", F.col("capacity") / F.col("weight"))
    name = [c for c in LEVELS if c in children.columns]
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy("filled_at", *name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = rows.withColumn("level", (F.col("of_parent") - before) / left)
    # the level at the first child that is not filled up holds for it and all after it
    first = F.min(F.when(F.col("filled_at") > F.col("level"), F.struct("filled_at", *name, "level"))).over(by)["level"]
    open_level = level.withColumn("open_level", first)
    budget = F.when(F.col("filled_at") <= F.col("level"), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.floor(F.col("open_level") * F.col("weight"))))
    return open_level.withColumn("budget", budget.cast("long")).drop("weight", "filled_at", "level", "open_level", "of_parent")


def leaf_budgets(sizes: DataFrame, weights: dict[str, dict[str, int]], budget: int | None, epochs: int) -> DataFrame:
    """domain, leaf_lang, leaf_source, tokens, rows and budget of each leaf; budget None: as many tokens as there are."""
    held = sizes.withColumn("capacity", F.col("tokens") * epochs)
    root = held.agg(F.coalesce(F.sum("capacity"), F.lit(0)).alias("most"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    whole = root.select(F.least(F.col("most"), F.col("all") if budget is None else F.lit(budget).cast("long")).alias("of_parent"))
    current, parents = whole, []
    for depth, level in enumerate(LEVELS):
        path = [*LEVELS[: depth + 1]]
        children = held.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
        joined = children.crossJoin(current) if not parents else children.join(current, parents)  # the root is one row
        shared = share_out(joined, parents, weight_of(level, weights))
        current, parents = shared.select(*path, F.col("budget").alias("of_parent")), path
    return shared


def mix_plan(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, domain: str = DOMAIN, budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """A row for each leaf: tokens, rows, budget, full_epochs, rest (tokens of the prefix), ranges, cut_range and cut (hash and id of its last document)."""
    named = with_leaves(docs.select("doc_id", "text", "lang", "source"), domain)
    narrow = settle(named.select(F.col("doc_id").cast("long").alias("doc_id"), *LEVELS, tokens_of(F.col("text")).alias("n_tokens")), "leaves")
    sizes = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = leaf_budgets(sizes, weights, budget, epochs).select(
        *LEVELS, "tokens", "rows", "budget",
        F.expr("case when tokens = 0 then 0 else budget div tokens end").alias("full_epochs"),
        F.expr("case when tokens = 0 then 0 else budget % tokens end").alias("rest"),
        F.ceil(F.sqrt("rows")).cast("long").alias("ranges"),
    )
    leaves = settle(leaves, "budgets")
    drawn = ranged(narrow.join(leaves.where("rest > 0"), [*LEVELS]), seed)
    sums = drawn.groupBy(*LEVELS, "rest", "hash_range").agg(F.sum("n_tokens").alias("in_range"))
    run = Window.partitionBy(*LEVELS).orderBy("hash_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sums.withColumn("through", F.sum("in_range").over(run)).where("through > rest and through - in_range <= rest")
    # a leaf's rest is below its tokens, so just one range holds the cut
    cut = cut.where("in_range > 0").select(*LEVELS, F.col("hash_range").alias("cut_range"), (F.col("rest") - F.col("through") + F.col("in_range")).alias("room"))
    inside = drawn.join(cut, [*LEVELS]).where("hash_range = cut_range").groupBy(*LEVELS, "room", "draw", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
    run = Window.partitionBy(*LEVELS).orderBy("draw", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("through", F.sum("n_tokens").over(run)).where("through <= room").groupBy(*LEVELS).agg(F.max(F.struct("draw", "doc_id")).alias("cut"))
    return settle(leaves.join(cut.drop("room"), [*LEVELS], "left").join(last, [*LEVELS], "left"), "mix")


def ranged(rows: DataFrame, seed: int) -> DataFrame:
    """Adds draw (the order of the epoch that follows the full ones) and hash_range to rows with doc_id, full_epochs and ranges."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    value = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    return rows.withColumn("draw", draw).withColumn("value", value).withColumn("hash_range", F.expr("(value * ranges) div 4294967296")).drop("value")


def with_copies(docs: DataFrame, plan: DataFrame, domain: str = DOMAIN, seed: int = SEED) -> DataFrame:
    """record (a row of docs), domain, leaf_lang, leaf_source and copies: how often each row is used. Only the leaves' table is joined; texts stay where they are."""
    records = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col("doc_id").cast("long").alias("doc_id"), "lang", "source")
    rows = ranged(with_leaves(records, domain).join(plan, [*LEVELS]), seed)
    earlier = F.struct("draw", "doc_id") <= F.col("cut")
    in_prefix = F.coalesce((F.col("rest") > 0) & ((F.col("hash_range") < F.col("cut_range")) | (F.col("hash_range") == F.col("cut_range")) & F.coalesce(earlier, F.lit(False))), F.lit(False))
    return rows.select("record", *LEVELS, (F.col("full_epochs") + in_prefix.cast("long")).alias("copies"))


def mix_copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, domain, lang, source (leaf names), n_tokens and copies of every row of docs.

    Null lang or source is the leaf ``unknown``. Null, empty and blank texts have
    no token: they cost nothing, and lie in the prefix if their draw does. Equal
    doc_ids of one leaf share a draw, so they are taken together or not at all.
    A leaf's prefix ends before the document that would pass its budget. Leaves
    without tokens get none. No rows give no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")
    keyed = {k: v for k, v in options.items() if k in ("domain", "seed")}
    rows = with_copies(narrow, mix_plan(docs, **options), **keyed)
    return rows.select("record.doc_id", "domain", F.col("leaf_lang").alias("lang"), F.col("leaf_source").alias("source"), tokens_of(F.col("record.text")).alias("n_tokens"), "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as its copies say, with the columns of docs."""
    keyed = {k: v for k, v in options.items() if k in ("domain", "seed")}
    rows = with_copies(docs, mix_plan(docs, **options), **keyed)
    return rows.where("copies > 0").select("record", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("record.*")


def oracle(weights: dict[str, dict[str, int]] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> str:
    """mix_copies of documents in DuckDB, each leaf sorted whole."""
    domain = "case when regexp_matches(source, '^src[0-9]+$') then 'domain' || (right('0' || substr(source, 4), 2)::int % 4) else 'other' end"
    parts = [
        f"""r as (select doc_id, {domain} "domain", coalesce(lang, 'unknown') leaf_lang, coalesce(source, 'unknown') leaf_source,
        len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::bigint n_tokens from documents)""",
        f"""leaf as (select "domain", leaf_lang, leaf_source, sum(n_tokens)::bigint tokens, (sum(n_tokens) * {epochs})::bigint capacity from r group by all)""",
        "b0 as (select least(sum(capacity), sum(tokens))::bigint of_parent from leaf)",
    ]
    for k, level in enumerate(LEVELS, 1):
        path = ", ".join(f'"{c}"' for c in LEVELS[:k])
        parent = ", ".join(f'"{c}"' for c in LEVELS[: k - 1])
        by = f"partition by {parent}" if parent else ""
        cases = " ".join(f"when '{n}' then {w}" for n, w in weights.get(level, {}).items())
        weight = f'case "{level}" {cases} else 1 end' if cases else "1"
        join = f"join b{k - 1} using ({parent})" if parent else "cross join b0"
        order = f"over ({by} order by filled_at, {path} rows between unbounded preceding and 1 preceding)"
        parts += [
            f"c{k} as (select {path}, sum(capacity)::bigint capacity, {weight} weight, sum(capacity)::bigint / ({weight}) filled_at from leaf group by {path})",
            f"l{k} as (select *, (of_parent - coalesce(sum(capacity) {order}, 0)::bigint) / (sum(weight) over ({by}) - coalesce(sum(weight) {order}, 0))::bigint lvl from c{k} {join})",
            f"o{k} as (select *, first(case when filled_at > lvl then lvl end order by case when filled_at > lvl then 0 else 1 end, filled_at, {path}) over ({by}) open_lvl from l{k})",
            f"b{k} as (select {path}, (case when filled_at <= lvl then capacity else least(capacity, floor(open_lvl * weight)) end)::bigint of_parent from o{k})",
        ]
    names = ", ".join(f'"{c}"' for c in LEVELS)
    parts += [
        f"e as (select r.*, case when tokens = 0 then 0 else of_parent // tokens end full_epochs, case when tokens = 0 then 0 else of_parent % tokens end rest from r join leaf using ({names}) join b{len(LEVELS)} using ({names}))",
        f"d as (select *, md5('{seed}:' || full_epochs || ':' || coalesce(doc_id::varchar, 'null')) draw from e)",
        f"t as (select *, sum(n_tokens) over (partition by {names} order by draw, doc_id nulls first range between unbounded preceding and current row) through from d)",
    ]
    return "with " + ",\n".join(parts) + """
    select doc_id, "domain", leaf_lang lang, leaf_source source, n_tokens, full_epochs + (rest > 0 and through <= rest)::int copies from t"""
