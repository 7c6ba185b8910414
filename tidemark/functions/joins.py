"""Join helpers.

No dimension is hinted: AQE broadcasts a side it has measured below
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and shuffles beyond it.
Dimension keys are unique (``dim_accounts`` has one row per account, and so on);
views that count rows after such a join rely on it.

``with_account`` is for the row-level views, which send every subscription to
its account. A counting pass finds the accounts that hold several tasks' worth
of rows; their subscriptions are dealt over as many pieces, and their one
dimension row is repeated for each. So the join stays one shuffle of even
partitions, whatever AQE's skew thresholds are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.star import Tables

# Stored bytes of the subscriptions below which accounts are not counted: such
# a fact is the work of a few tasks.
HOT_BYTES = 256 << 20
# Tasks' worth of rows that make an account hot, and pieces for each of them:
# pieces meet in partitions by chance, so small ones keep those even.
HOT_TASKS = 1
PIECES = 4


def account_attrs(t: Tables, *cols: str) -> DataFrame:
    """dim_accounts projected to the key and the wanted attributes."""
    return t.accounts.select("account_sk", *cols)


def in_dim(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """`df JOIN dim USING (key)` for a dimension used only as an existence
    filter: an inner join with the dimension's key column alone. Rows with a
    NULL or unknown key drop out, and a duplicated dimension key repeats the
    row, exactly as the original inner joins do. Unlike a left-semi join,
    the optimizer does not move it below an aggregate that precedes it, so
    a view that reduces its facts first joins the reduced rows."""
    return df.join(dim.select(key), key)


def hot_accounts(t: Tables) -> dict[int, list[int]]:
    """Pieces (a power of two) -> accounts whose rows they spread. At most one
    account in HOT_TASKS shuffle partitions is hot, so the lists are bounded."""
    if "hot_accounts" not in t.cache:
        held, out = t.input_bytes("subscriptions"), {}
        if held is not None and held >= HOT_BYTES:
            tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
            share = max(1, t.subscriptions.count() // tasks)
            counts = (t.subscriptions.where(F.col("account_sk").isNotNull()).groupBy("account_sk")
                      .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_TASKS * share))
            for account, n in counts.collect():
                out.setdefault(1 << (-(-n * PIECES // share) - 1).bit_length(), []).append(account)
        t.cache["hot_accounts"] = out
    return t.cache["hot_accounts"]


def _by_account(hot: dict[int, list[int]], value, other) -> Column:
    out = other
    for pieces, accounts in sorted(hot.items()):
        out = F.when(F.col("account_sk").isin(accounts), value(pieces)).otherwise(out)
    return out


def with_account(t: Tables, subs: DataFrame, by: list[str], *cols: str) -> DataFrame:
    """`subs JOIN dim_accounts USING (account_sk)` with the attributes ``cols``;
    the columns ``by`` tell an account's subscriptions apart."""
    accounts, hot = account_attrs(t, *cols), hot_accounts(t)
    if not hot:
        return subs.join(accounts, "account_sk")
    zero = F.lit(0).cast("long")
    piece = _by_account(hot, lambda n: F.pmod(F.xxhash64(*by), F.lit(n).cast("long")), zero)
    pieces = _by_account(hot, lambda n: F.lit(n - 1).cast("long"), zero)
    return subs.withColumn("_piece", piece).join(
        accounts.withColumn("_piece", F.explode(F.sequence(zero, pieces))), ["account_sk", "_piece"]).drop("_piece")
