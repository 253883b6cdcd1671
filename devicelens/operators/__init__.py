"""Relational building blocks shared by the jobs."""

from devicelens.operators.audit import key_multiplicities, key_multiplicity
from devicelens.operators.joins import after_latest, latest_per_key, repeat_rows
from devicelens.operators.rank import bucketed_rank, first_by_rank, rank_buckets, with_rank

__all__ = ["after_latest", "bucketed_rank", "first_by_rank", "key_multiplicity",
           "latest_per_key", "rank_buckets", "repeat_rows", "key_multiplicities", "with_rank"]
