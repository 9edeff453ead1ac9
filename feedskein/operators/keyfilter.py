"""Bitmaps of hashed keys that keep rows which cannot match out of a join's shuffle.

A key falls in one of many slots. The slots of a set of keys are a bitmap, in pieces of 4 KB,
one row per piece, which are made by partial aggregation and can be merged: so an index of the
live articles is kept by adding the pieces of each append. A row whose slot is empty is surely
not in the set; one in SLOTS_PER_KEY of the others is let through by chance, which costs a row
in the join that follows and never changes its result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedskein.operators.articles import first_observations
from feedskein.schemas import ARTICLE_KEY
from feedskein.session import written

SLOTS_PER_KEY = 64
PIECE = 32768  # slots in a piece, as Spark's bitmap functions have it


def slots_for(keys: int) -> int:
    """A number of slots for so many keys: whole pieces."""
    return max(1, -(-keys * SLOTS_PER_KEY // PIECE)) * PIECE


def _slot(keys, slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots))


def key_bits(rows: DataFrame, slots: int, keys=ARTICLE_KEY) -> DataFrame:
    """(piece, bits, slots): the pieces of the bitmap that are not empty. All that are merged or
    asked together must have the same number of slots."""
    slot = _slot(keys, slots) + 1  # Spark's pieces begin at slot 1
    return rows.groupBy(F.bitmap_bucket_number(slot).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"), F.lit(slots).cast("long").alias("slots"))


def merged_bits(bits: DataFrame) -> DataFrame:
    """The bitmap of all keys of several, given as one frame."""
    return bits.groupBy("piece", "slots").agg(F.bitmap_or_agg("bits").alias("bits")).select("piece", "bits", "slots")


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, F.pmod(position, F.lit(8)).cast("int")) == 1


def possible(rows: DataFrame, bits: DataFrame, slots: int, keys=ARTICLE_KEY) -> DataFrame:
    """The rows whose key may be in the set: all that are, and few others. Rows meet the pieces
    by number; a bitmap within the broadcast limit leaves them where they are."""
    slot = _slot(keys, slots) + 1
    numbered = rows.withColumns({"_piece": F.bitmap_bucket_number(slot), "_position": F.bitmap_bit_position(slot)})
    asked = numbered.join(bits.select(F.col("piece").alias("_piece"), F.col("bits").alias("_bits")), "_piece")
    return asked.filter(_is_set(F.col("_bits"), F.col("_position"))).select(*rows.columns)


def new_observations(observations: DataFrame, live: DataFrame, live_bits=None, slots=None) -> DataFrame:
    """What operators.articles.new_observations gives, for a batch that is small beside the live
    table: of that, only rows that may match are shuffled.

    live_bits, an index of the live keys with that number of slots, decides first which
    observations are surely new; the others make the bitmap that live rows must pass.
    """
    first = written(first_observations(observations), "first")
    asked = first.select(*ARTICLE_KEY)
    if live_bits is not None:
        asked = possible(asked, live_bits, slots)
    batch = slots_for(asked.count())
    bits = written(key_bits(asked, batch), "bits")
    candidates = possible(live.select(*ARTICLE_KEY), bits, batch)
    return first.join(candidates, ARTICLE_KEY, "left_anti")
