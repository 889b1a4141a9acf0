"""Duplicate groups: distances of hashes, merged sets, survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.ladder import best_per_group
from gleanery.session import shared_path


def settle(rows: DataFrame) -> DataFrame:
    """Writes rows to the shared checkpoint folder and reads them again; in a local session without one, to a temporary folder."""
    path = shared_path(rows.sparkSession, "settled")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def hex_lanes(digest: Column, lanes: int) -> list[Column]:
    """A hex digest as signed 64-bit lanes."""
    return [F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long") for k in range(lanes)]


def hamming(one: list[Column], two: list[Column]) -> Column:
    """Differing bits of two hashes given as lanes."""
    total = F.lit(0)
    for a, b in zip(one, two, strict=True):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total


def lane_bits(lanes: list[Column], begin: int, end: int) -> Column:
    """Bits [begin, end) of 64-bit lanes in a row, 63 at most, as a number."""
    lane, at = divmod(begin, 64)
    over = end - 64 * (lane + 1)  # bits that lie in the next lane
    mask = lambda width: F.lit((1 << width) - 1)
    if over <= 0:
        return F.shiftrightunsigned(lanes[lane], -over).bitwiseAND(mask(end - begin))
    high = F.shiftleft(lanes[lane].bitwiseAND(mask(64 - at)), over)
    return high.bitwiseOR(F.shiftrightunsigned(lanes[lane + 1], 64 - over))


def _band_keys(value: Column, band: int, width: int) -> Column:
    """The value of a band, and the value with each of its bits turned."""
    key = lambda turn, of: F.struct(F.lit(band).alias("band"), turn.cast("int").alias("turn"), of.alias("key"))
    turned = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: key(i, value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    return F.concat(F.array(key(F.lit(-1), value)), turned)


def band_candidates(reps: DataFrame, id_col: str, lanes: list[str], most: int) -> DataFrame:
    """a, b, a_<lane>, b_<lane>: pairs a < b that differ in at most two bits of some band, once for each such band.

    With most // 3 + 1 bands, hashes of at most ``most`` differing bits have such a band. A hash is dealt to the value of
    each band and to those of one bit turned, so that near bands meet in an equality join. Two that differ in two bits
    meet twice, by either bit turned, and equal ones by every bit: only the meeting of the lesser turn is taken.
    """
    bits, bands = 64 * len(lanes), most // 3 + 1
    edges = [bits * k // bands for k in range(bands + 1)]
    if max(b - a for a, b in zip(edges, edges[1:], strict=False)) > 63:
        raise ValueError("too few bands: a band must fit 63 bits")
    columns = [F.col(c) for c in lanes]
    keys = [_band_keys(lane_bits(columns, a, b), k, b - a) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    dealt = reps.select(id_col, *lanes, F.explode(F.flatten(F.array(*keys))).alias("_k")).select(id_col, *lanes, "_k.*")
    dealt = settle(dealt)
    side = lambda s: dealt.select(F.col(id_col).alias(s), F.col("band").alias(f"{s}_band"), F.col("key").alias(f"{s}_key"), F.col("turn").alias(f"{s}_turn"), *[F.col(c).alias(f"{s}_{c}") for c in lanes])
    once = "a_turn < b_turn OR (a_turn = -1 AND b_turn = -1)"
    met = side("a").join(side("b"), F.expr(f"a_band = b_band AND a_key = b_key AND a < b AND ({once})"))
    return met.select("a", "b", *[f"{s}_{c}" for s in "ab" for c in lanes])


def hamming_pairs(hashed: DataFrame, id_col: str, lanes: list[str], most: int) -> DataFrame:
    """Pairs a < b of at most ``most`` differing bits, a and b being the smallest ids of their hashes, and of every
    further holder of a hash its pair with the smallest (0 bits): copies are not expanded into all pairs.

    Of n random hashes of 128 bits and ``most`` 20, about n * n / 500 pairs are compared.
    """
    reps = settle(hashed.groupBy(*lanes).agg(F.min(id_col).alias("_rep")))
    copies = hashed.join(reps, lanes).filter(F.col(id_col) != F.col("_rep")).select(F.col("_rep").alias("a"), F.col(id_col).alias("b"), F.lit(0).alias("bits"))
    near = hamming([F.col(f"a_{c}") for c in lanes], [F.col(f"b_{c}") for c in lanes])
    met = band_candidates(reps, "_rep", lanes, most).withColumn("bits", near).filter(F.col("bits") <= most)
    return met.select("a", "b", "bits").distinct().unionByName(copies)


def merged_sets(pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """pairs: a, b, priority. node, set_id (smallest node) and priority (least of the set's pairs) of every node.

    Each round takes the least label of the neighbours and the label's own label; not to settle is an error.
    """
    pairs = settle(pairs.select("a", "b", "priority"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        step = labels.join(near, "node").select("node", F.least("label", "_near").alias("label"))
        up = step.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        new = settle(step.join(up, F.col("label") == F.col("_n")).select("node", F.least("label", "_up").alias("label")))
        settled = new.join(labels.withColumnRenamed("label", "_old"), "node").filter("label <> _old").isEmpty()
        labels = new
        if settled:
            break
    else:
        raise ValueError(f"sets did not settle in {most_rounds} rounds")
    kinds = pairs.join(labels.withColumnRenamed("node", "a"), "a").groupBy("label").agg(F.min("priority").alias("priority"))
    return labels.join(kinds, "label").select("node", F.col("label").alias("set_id"), "priority")


def survivors(members: DataFrame, alive: Column, order: list[Column]) -> DataFrame:
    """Of each set with two live members or more the best live member stays: node, set_id, kept (boolean)."""
    live = members.filter(alive)
    ranked = best_per_group(live, ["set_id"], order, "_rank")
    sizes = live.groupBy("set_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    return ranked.join(sizes, "set_id").select("node", "set_id", (F.col("_rank") == 1).alias("kept"))
