"""Parallel list ranking by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.session import cut_counted


def rank_lists(elements: DataFrame, weights: list[str]) -> DataFrame:
    """(id, head, *weights) of each element of linked lists (id, previous, *weights).

    head is the first element of the list, a weight the sum from there to the element, itself included. Each round
    doubles the distance that every element looks back, so the rounds are logarithmic in the longest list. Elements
    of a ring, or behind one, never reach a first element and get a null head.
    """
    open_ = F.col("previous").isNotNull()
    state, left = cut_counted(elements.select("id", "previous", F.when(~open_, F.col("id")).alias("head"), *weights), open_)
    while left:
        before = state.select(F.col("id").alias("previous"), F.col("previous").alias("b_previous"), F.col("head").alias("b_head"), *(F.col(w).alias(f"b_{w}") for w in weights))
        jumped = state.where(open_).join(before, "previous").select(
            "id", F.col("b_previous").alias("previous"), F.col("b_head").alias("head"), *((F.col(w) + F.col(f"b_{w}")).alias(w) for w in weights)
        )
        state, now = cut_counted(state.where(~open_).unionByName(jumped), open_, bounded=True)
        if now == left:
            break  # a list of any length gets shorter in every round, so only rings are left
        left = now
    return state.select("id", "head", *weights)
