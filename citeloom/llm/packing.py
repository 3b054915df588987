"""Filling containers of fixed capacity, by a grouping genetic algorithm on islands.

Items are dealt to shards of bounded size by hash; every shard is evolved on several
islands (tasks) at once.  A solution is a list of bins.  Crossover injects whole
well-filled bins of one parent into the other, drops the bins that now hold an item
twice, and puts the displaced items back by best fit.  After each epoch every island
gets its neighbour's elite.  What the best solutions leave in loosely filled bins is
pooled, dealt anew and evolved once more.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.frames import nonempty
from citeloom.staging import drop_staged, stage

#: Items in a shard on average, islands per shard, epochs, generations per epoch at most, solutions per island.
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4_000, 2, 2, 150, 6
#: Generations in a row after which an island stops if they brought no bin less and no such gain in the mean of squared fills.
PATIENCE, GAIN = 8, 2e-5
#: Items of a bin up to which pairs of them are exchanged.
PAIRED = 8
#: A bin is well filled from this share on; loose bins below it are packed anew.
WELL = 0.995


def best_fit(order, sizes, capacity, bins=None):
    """Put items, in the given order, where the least space is left; opens bins as needed.

    ``bins``: list of lists of items, changed in place.  Returns it.
    """
    bins = [] if bins is None else bins
    left = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    left = [x for x in left if x[0] > 0]
    for i in order:
        s = sizes[i]
        at = bisect_left(left, (s, -1))
        if at < len(left):
            room, k = left.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room > s:
            insort(left, (room - s, k))
    return bins


def fitness(bins, sizes, capacity) -> float:
    """Mean of the squared fill: fewer and fuller bins are better."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def exchange(bins, displaced, sizes, capacity):
    """Trade items of bins for larger displaced ones that fill them better: one for one, two for one and two for two.

    Bins are changed in place; returns what is displaced now, which is smaller and easier to place.
    """
    loose = sorted((sizes[i], i) for i in displaced)
    for x in bins:
        room = capacity - sum(sizes[i] for i in x)
        if not room or not loose:
            continue
        best = None  # (fill, what goes, what comes)
        for out in [(i,) for i in x] + ([(a, b) for k, a in enumerate(x) for b in x[k + 1 :]] if len(x) <= PAIRED else []):
            size = sum(sizes[i] for i in out)
            at = bisect_left(loose, (size + room + 1, -1)) - 1
            if at >= 0 and loose[at][0] > size and (best is None or loose[at][0] - size > best[0]):
                best = loose[at][0] - size, out, (loose[at],)
            if len(out) == 2:
                i, j = 0, len(loose) - 1
                while i < j:
                    total = loose[i][0] + loose[j][0]
                    if total > size + room:
                        j -= 1
                        continue
                    if total > size and (best is None or total - size > best[0]):
                        best = total - size, out, (loose[i], loose[j])
                    i += 1
            if best is not None and best[0] == room:
                break
        if best is not None:
            for i in best[1]:
                x.remove(i)
            for e in best[2]:
                loose.remove(e)
                x.append(e[1])
            for i in best[1]:
                insort(loose, (sizes[i], i))
    return [i for _, i in loose]


def crossover(a, b, sizes, capacity, rng):
    """A child of ``a`` with well-filled bins of ``b``."""
    good = [x for x in b if sum(sizes[i] for i in x) >= WELL * capacity]
    if not good:
        good = sorted(b, key=lambda x: -sum(sizes[i] for i in x))[: max(1, len(b) // 4)]
    start = rng.randrange(len(good))
    injected = (good + good)[start : start + max(1, len(good) // 3)][: len(good)]
    taken = {i for x in injected for i in x}
    child, displaced = [list(x) for x in injected], []
    for x in a:
        if taken.isdisjoint(x):
            child.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    # some loose bins are opened too, so that their items may find better places
    rest = sorted(range(len(injected), len(child)), key=lambda k: sum(sizes[i] for i in child[k]))
    opened = rest[: 1 + rng.randrange(max(4, len(rest) // 12))]
    for k in sorted(opened, reverse=True):
        displaced += child.pop(k)
    displaced = exchange(child, displaced, sizes, capacity)
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(displaced, sizes, capacity, child)


def least_bins(sizes, capacity) -> int:
    """Bins that any solution needs."""
    return -(-sum(sizes) // capacity)


def evolve(sizes, capacity, solutions, generations, population, seed, patience=None):
    """The population after ``generations`` steps, best first.  Without solutions it starts from best fit.

    Ends earlier where no solution can have fewer bins than the best one, or ``patience``
    generations in a row brought nothing better.
    """
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    pool = list(solutions) or [best_fit(order, sizes, capacity)]
    enough = least_bins(sizes, capacity)

    def rank(found):
        return sorted(found, key=lambda x: (len(x[2]), -x[0], x[1]))

    if min(map(len, pool)) > enough:
        while len(pool) < population:
            noisy = sorted(order, key=lambda i: (-sizes[i] * rng.uniform(0.8, 1.0), i))
            pool.append(best_fit(noisy, sizes, capacity))
    scored = rank((fitness(s, sizes, capacity), k, s) for k, s in enumerate(pool))
    held, still, number = (len(scored[0][2]), scored[0][0]), 0, 0
    for _ in range(generations):
        if len(scored[0][2]) <= enough or still >= (PATIENCE if patience is None else patience):
            break
        children = []
        for k in range(max(1, population // 2)):
            mother, father = scored[k % len(scored)][2], scored[rng.randrange(len(scored))][2]
            c = crossover(mother, father, sizes, capacity, rng)
            number += 1
            children.append((fitness(c, sizes, capacity), -number, c))
        scored = rank(scored + children)[:population]
        if len(scored[0][2]) < held[0] or scored[0][0] > held[1] + GAIN:
            held, still = (len(scored[0][2]), scored[0][0]), 0
        else:
            still += 1
    return scored


def _assignment(bins, n):
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(assignment):
    out: list[list[int]] = [[] for _ in range(max(assignment, default=-1) + 1)]
    for i, k in enumerate(assignment):
        out[k].append(i)
    return [b for b in out if b]


_STATE = "pack string, capacity int, shard int, island int, ids array<string>, sizes array<int>, best array<int>, second array<int>, fit double, bins array<int>"


def _epoch(rows: DataFrame, epoch: int, generations: int, population: int) -> DataFrame:
    @nonempty
    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                sizes = [int(x) for x in r.sizes]
                start = [_bins(list(map(int, s))) for s in (r.best, r.second, r.guest) if s is not None and len(s)]
                # how many bins there were before each epoch: those of best fit at first
                history = [int(x) for x in r.bins] or [len(best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, int(r.capacity)))]
                done = evolve(sizes, int(r.capacity), start, generations, population, hash((int(r.shard), int(r.island), epoch)))
                best = _assignment(done[0][2], len(sizes))
                second = _assignment(done[1][2], len(sizes)) if len(done) > 1 else []
                out.append((r.pack, r.capacity, r.shard, r.island, list(r.ids), sizes, best, second, done[0][0], [*history, len(done[0][2])]))
            yield pd.DataFrame(out, columns=["pack", "capacity", "shard", "island", "ids", "sizes", "best", "second", "fit", "bins"])

    return rows.mapInPandas(run, _STATE)


def _pack_shards(items: DataFrame, label: str, shard: int, islands: int, epochs: int, generations: int, population: int, gains: list | None = None) -> DataFrame:
    """(pack, capacity, container, id, size) for items (pack, capacity, id, size) with size <= capacity."""
    spark = items.sparkSession
    counts = items.groupBy("pack").agg(F.count("*").alias("n")).select("pack", F.ceil(F.col("n") / shard).cast("int").alias("shards"))
    dealt = items.join(F.broadcast(counts), "pack").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    cells = dealt.groupBy("pack", "capacity", "shard").agg(F.array_sort(F.collect_list(F.struct("id", "size"))).alias("x"))
    empty = F.array().cast("array<int>")
    state = cells.select("pack", "capacity", "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.id").alias("ids"), F.col("x.size").alias("sizes"), empty.alias("best"), empty.alias("second"), empty.alias("guest"), empty.alias("bins"))
    tasks = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    previous = None
    for epoch in range(epochs):
        state = stage(_epoch(state.repartition(tasks, "pack", "shard", "island"), epoch, generations, population), "pack")
        drop_staged(previous)
        previous = state
        if epoch + 1 < epochs:
            guests = state.select("pack", "shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("best").alias("guest"))
            state = state.join(guests, ["pack", "shard", "island"]).drop("fit")
    top = previous.groupBy("pack", "shard").agg(F.max(F.struct((-F.element_at("bins", -1)).alias("n"), "fit", (-F.col("island")).alias("i"))).alias("b")).select("pack", "shard", (-F.col("b.i")).alias("island"))
    if gains is not None:
        gains.append(previous.join(top, ["pack", "shard", "island"]).select("pack", F.lit(label).alias("step"), "shard", "bins", F.ceil(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x) / F.col("capacity")).cast("int").alias("least")))
    won = previous.join(top, ["pack", "shard", "island"]).select("pack", "capacity", "shard", F.explode(F.arrays_zip("ids", "sizes", "best")).alias("x"))
    return won.select("pack", "capacity", F.concat_ws("-", F.lit(label), "shard", "x.best").alias("container"), F.col("x.ids").alias("id"), F.col("x.sizes").alias("size"))


def fill_containers(sizes: DataFrame, key: str, size: str, packs: list[tuple[str, int]], shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, gains: list | None = None) -> DataFrame:
    """Lay every item into containers of each (name, capacity) of ``packs``.

    One row (pack_name, capacity_tokens, container, key, piece, tokens) per placed piece.
    An item within the capacity is one piece 0; a longer one is cut into full containers
    and a last piece that is placed like any other item.  Items of null, zero or negative
    size are left out.  Keys should be unique: a repeated key is counted as another item.
    Equal choices go to the smaller item, bin and island, so results repeat.  To a list
    ``gains`` are added, for both steps, DataFrames (pack, step, shard, bins, least): the bins
    of best fit and after every epoch, and those that any solution needs.
    """
    spark = sizes.sparkSession
    packs = [(str(n), int(c)) for n, c in packs if c and c > 0]
    out_schema = f"pack_name string, capacity_tokens int, container string, {key} {dict(sizes.dtypes)[key]}, piece int, tokens int"
    if not packs:
        return spark.createDataFrame([], out_schema)
    table = F.array(*[F.struct(F.lit(n).alias("pack"), F.lit(c).alias("capacity")) for n, c in packs])
    base = sizes.select(F.col(key).cast("string").alias("id"), F.col(size).cast("bigint").alias("n")).where("n > 0 and id is not null")
    wide = base.select("id", "n", F.explode(table).alias("p")).select("id", "n", F.col("p.pack").alias("pack"), F.col("p.capacity").alias("capacity"))
    wide = wide.withColumn("full", F.floor(F.col("n") / F.col("capacity")).cast("int")).withColumn("rest", F.expr("cast(n % capacity as int)"))
    pieces = wide.where("full > 0").select("pack", "capacity", "id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    whole = pieces.select("pack", "capacity", F.concat_ws("-", F.lit("full"), "id", "piece").alias("container"), "id", "piece", F.col("capacity").alias("size"))
    items = wide.where("rest > 0").select("pack", "capacity", F.concat_ws(":", "id", "full").alias("id"), F.col("rest").alias("size"))
    first = stage(_pack_shards(items, "a", shard, islands, epochs, generations, population, gains), "packed")
    load = first.groupBy("pack", "container").agg(F.sum("size").alias("load"))
    marked = first.join(load, ["pack", "container"]).withColumn("loose", F.col("load") < WELL * F.col("capacity"))
    loose = stage(marked.where("loose").select("pack", "capacity", "id", "size"), "loose")
    second = _pack_shards(loose, "b", shard, islands, epochs, generations, population, gains)
    placed = marked.where("not loose").select(*second.columns).unionByName(second)
    cut = placed.select("pack", "capacity", "container", F.substring_index("id", ":", -1).cast("int").alias("piece"), F.expr("substring(id, 1, length(id) - length(substring_index(id, ':', -1)) - 1)").alias("id"), "size")
    both = cut.unionByName(whole)
    return both.select(F.col("pack").alias("pack_name"), F.col("capacity").alias("capacity_tokens"), "container", F.col("id").cast(dict(sizes.dtypes)[key]).alias(key), "piece", F.col("size").alias("tokens"))
