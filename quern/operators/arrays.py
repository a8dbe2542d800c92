"""Token arrays of a whole corpus, and language-model windows over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.codec import encode
from quern.operators.prefix import running_total
from quern.operators.train import Tokenizer
from quern.sources.shared import keyed, written


def token_array(docs: DataFrame, tokenizer: Tokenizer, end: int, key: str = "doc_id") -> DataFrame:
    """(pos, token_id) over all documents by key, each followed by the end id.

    Lengths alone are summed over the corpus; each document's start then joins its text, which is
    encoded in place. So texts move once at most, ids never. Null texts have the end id alone; rows
    that share a key stay apart.
    """
    rows = keyed(docs.select(F.col(key).alias("key"), "text"), "row")
    closed = F.concat(F.coalesce("ids", F.array().cast("array<int>")), F.array(F.lit(end)))
    sizes = written(encode(rows, tokenizer).select("key", "row", (F.coalesce(F.array_size("ids"), F.lit(0)) + 1).alias("n")), "sizes")
    starts = running_total(sizes, ["key", "row"], "n", "start").select("row", "start")
    placed = encode(rows.join(starts, "row").select("start", "text"), tokenizer)
    return placed.select("start", F.posexplode(closed).alias("k", "token_id")).select((F.col("start") + F.col("k")).alias("pos"), "token_id")


def checked_uint16(tokens: DataFrame) -> DataFrame:
    """The same rows; the job fails if an id needs more than 16 bits."""
    fits = F.assert_true(F.col("token_id").between(0, 65_535), F.lit("a token id needs more than 16 bits"))
    return tokens.where(fits.isNull())


def windows(encoded: DataFrame, context: int, key: str = "doc_id") -> DataFrame:
    """(key, start, x, y) for every start within a document's ids; y is x moved by one."""
    last = F.size("ids") - context - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last))
    cut = encoded.select(key, "ids", F.explode(starts).alias("start"))
    return cut.select(key, "start", F.slice("ids", F.col("start") + 1, context).alias("x"), F.slice("ids", F.col("start") + 2, context).alias("y"))


def sample_windows(encoded: DataFrame, context: int, batch: int, seed: int, key: str = "doc_id") -> DataFrame:
    """``batch`` windows drawn with equal chance among all starts of all documents, by hash order. Only
    starts are drawn from; the few drawn then meet their documents again."""
    rows = keyed(encoded.select(key, "ids"), "_row")
    last = F.size("ids") - context - 1
    starts = rows.select(key, "_row", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("start"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("start").cast("string")))
    drawn = starts.orderBy(order, key, "start").limit(batch).select("_row", "start")
    cut = rows.join(F.broadcast(drawn), "_row")  # ``batch`` rows
    return cut.select(key, "start", F.slice("ids", F.col("start") + 1, context).alias("x"), F.slice("ids", F.col("start") + 2, context).alias("y"))
