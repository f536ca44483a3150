"""What a tokenizer's table of encodings holds, field by field, and its exports to the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import encoding as E

#: The names under which fields are exported.
NAMES = {"input_ids": "ids", "token_type_ids": "type_ids", "attention_mask": "attention_mask", "special_tokens_mask": "special_tokens_mask", "offset_mapping": "offsets"}


@dataclass(frozen=True)
class BatchEncoding:
    """rows: a table with column encoding, and overflowing where texts were truncated."""

    rows: DataFrame

    def keys(self) -> list[str]:
        return list(NAMES)

    def __getitem__(self, key: str) -> Column:
        """A field of every encoding, by its exported name or its own."""
        field = NAMES.get(key, key)
        if field not in E.FIELDS:
            raise KeyError(key)
        return F.col("encoding")[field]

    def get(self, key: str, default: Column | None = None) -> Column | None:
        return self[key] if NAMES.get(key, key) in E.FIELDS else default

    def __len__(self) -> int:
        return self.rows.count()

    def n_overflowing(self) -> Column:
        return F.size("overflowing") if "overflowing" in self.rows.columns else F.lit(0)

    def to_dict(self) -> DataFrame:
        """rows with one column for each key."""
        return self.rows.select(*[c for c in self.rows.columns if c not in ("encoding", "overflowing")], *[self[k].alias(k) for k in NAMES])

    def numpy(self, key: str = "input_ids", limit: int = 10_000) -> np.ndarray:
        """A field of at most `limit` encodings as a matrix of longs; they must have one length, as padding gives them."""
        got = [r[0] for r in self.rows.select(self[key]).limit(limit).collect()]
        if len({len(r) for r in got}) > 1:
            raise ValueError("encodings differ in length; pad them first")
        return np.array([[tuple(x) if key == "offset_mapping" else x for x in r] for r in got], np.int64)
