"""Known accounts: records that share an id of any kind belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.session import written

#: Values that name no account.
NO_ID = ("", "unknown")


def _ids(records: DataFrame, record: str, kinds: list[str]) -> DataFrame:
    """record, kind, value of every id; empty ones and those of nobody are left out."""

    def one(kind: str) -> Column:
        value = F.trim(F.col(kind).cast("string"))
        return F.when(F.coalesce(F.lower(value), F.lit("")).isin(*NO_ID), None).otherwise(F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    found = F.explode(F.filter(F.array(*[one(k) for k in kinds]), lambda i: i.isNotNull()))
    return records.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), found.alias("i")).select("record", "i.kind", "i.value").distinct()


def account_groups(records: DataFrame, record: str, kinds: list[str], most_rounds: int = 60) -> DataFrame:
    """record and account of every record: the smallest record that ids connect it with, over any number of others.

    In each round every id takes the smallest account among its records, every
    record the smallest among its ids, and then the account of its account, which
    halves chains. Ids with very many records are summed up before they meet.
    Rounds are written, so that lost executors cost one. Records without an id
    are accounts of their own; records that share a name are one.
    """
    ids = written(_ids(records, record, kinds), "account-ids")
    own = records.where(F.col(record).isNotNull()).select(F.col(record).alias("record")).distinct()
    now = written(own.withColumn("account", F.col("record")), "accounts")
    for _ in range(most_rounds):
        least = ids.join(now, "record").groupBy("kind", "value").agg(F.min("account").alias("least"))
        offered = ids.join(least, ["kind", "value"]).groupBy("record").agg(F.min("least").alias("least"))
        hooked = now.join(offered, "record", "left").select("record", F.least("account", "least").alias("account"), F.col("account").alias("old"))
        # an account that now belongs to a smaller one takes all its records along
        moved = hooked.where("account < old").groupBy("old").agg(F.min("account").alias("to")).withColumnRenamed("old", "at")
        hooked = hooked.join(moved, hooked["account"] == moved["at"], "left").select("record", F.coalesce("to", "account").alias("account"), "old")
        hooked = written(hooked, "accounts")
        now = hooked.select("record", "account")
        if hooked.where("account < old").isEmpty():
            return now
    raise RuntimeError("accounts did not settle")


def known_accounts(records: DataFrame, record: str, kinds: list[str]) -> DataFrame:
    """account, kind, value: every id that is known of an account, once."""
    ids = _ids(records, record, kinds)
    return ids.join(account_groups(records, record, kinds), "record").select("account", "kind", "value").distinct()
