"""Filling containers of fixed capacity: vector best-fit over tokens, documents and attention cost.

Every text is measured in tokens of a public tokenizer. A text longer than the capacity is cut into full containers and
a rest; no other text is ever divided. Items are dealt to groups of about GROUP items by a hash of their key, so that a
group is bounded whatever the corpus is like, and each group is packed on its own: items in falling order of size
are put into the open container that fits under every capacity and whose remaining capacities, weighted, leave the least
residual norm after the item, or have the greatest product with it: WAYS are tried in turn until one reaches the lower
bound, and the one with the fewest containers is kept. The capacities are

- tokens: `capacity`;
- documents: `max_documents`, so that a container of crumbs does not need a mask of hundreds of blocks;
- attention cost: the sum of squared sizes of a container that holds several documents stays within `max_cost`. A
  container with one document is always allowed, since no document within the capacity may be divided.

The last two refuse items at the defaults as well: a long item takes no company beyond the cost, short ones close a
container by their number. fill() reports how much of each capacity is used. The fill lost at the ends of groups is at
most one part-filled container in a group of thousands of items.

Defined cases: null and empty texts take no space: one row with 0 tokens and no container; equal texts are
packed each; ties go to the fullest container opened first, so a result depends on nothing but the rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import arrow_map

CAPACITY = 2048
MAX_DOCUMENTS = 64
#: Attention cost of a container of several documents, as a part of that of one full document.
MAX_COST_PART = 0.9
GROUP = 4096
#: Groups that one task packs one after the other.
GROUPS_A_TASK = 4
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Weights of the residual tokens, documents and attention cost; each way of weighing is tried in a group, and the one with
#: the fewest containers is kept. True: the bin of the greatest weighted product of item and room, else of the least norm.
WAYS = (((1.0, 0.05, 0.05), False), ((1.0, 1.0, 0.05), False), ((1.0, 1.0, 1.0), True))

_ENCODINGS: dict[int, object] = {}


def tokenizer_file(path: str) -> tuple[str, bytes]:
    """(pattern, ranks) of a tokenizer, read on the driver and sent to the tasks with the job; a vocabulary is of fixed size."""
    import public_tokenizers

    with open(path, "rb") as f:
        return public_tokenizers.PATTERN, f.read()


def encoding(pattern: str, ranks: bytes):
    """The tokenizer of a ranks file, built once per worker."""
    k = hash((pattern, ranks))
    if k not in _ENCODINGS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODINGS[k] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[k]


def best_fit(sizes: np.ndarray, capacity: int, max_documents: int, max_cost: float) -> np.ndarray:
    """The container of each item, by the way of weighing that takes the fewest; the first one wins a tie."""
    least = max(-(-int(sizes.sum()) // capacity), -(-len(sizes) // max_documents)) if len(sizes) else 0
    best, n = None, 0
    for weights, product in WAYS:
        where = one_fit(sizes, capacity, max_documents, max_cost, weights, product)
        made = int(where.max()) + 1 if len(where) else 0
        if best is None or made < n:
            best, n = where, made
        if n <= least:  # no packing takes fewer
            break
    return best


def one_fit(sizes: np.ndarray, capacity: int, max_documents: int, max_cost: float, weights: tuple[float, float, float], product: bool) -> np.ndarray:
    """The container of each item; sizes are at most the capacity. Items must come in falling order of size.

    The cost of a container counts from its second item on: one item alone is always allowed.
    """
    n = len(sizes)
    where = np.empty(n, np.int64)
    if not n:
        return where
    least = float(sizes[-1])
    tokens, docs, cost, number = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    w0, w1, w2 = weights
    used = made = 0
    for i in range(n):
        s = float(sizes[i])
        c = s * s
        t = tokens[:used]
        fits = (t >= s) & (docs[:used] >= 1) & (cost[:used] >= c)
        if fits.any():
            if product:
                left = -(w0 * t * s / capacity**2 + w1 * docs[:used] / max_documents**2 + w2 * cost[:used] * c / max_cost**2)
            else:
                rt, rd, rc = (t - s) / capacity, (docs[:used] - 1) / max_documents, (cost[:used] - c) / max_cost
                left = w0 * rt * rt + w1 * rd * rd + w2 * rc * rc
            b = int(np.argmin(np.where(fits, left, np.inf)))
            tokens[b] -= s
            docs[b] -= 1
            cost[b] -= c
        else:
            b = used
            tokens[b], docs[b], cost[b], number[b] = capacity - s, max_documents - 1, max_cost - c, made
            used, made = used + 1, made + 1
        where[i] = number[b]
        if tokens[b] < least or docs[b] < 1 or cost[b] < least * least:  # full: nothing fits any more
            used -= 1
            for a in (tokens, docs, cost, number):
                a[b:used] = a[b + 1 : used + 1].copy()
    return where


def measured(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of every row; null texts have 0 tokens."""
    kind = dict(df.dtypes)[key]
    sent = df.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer))

    def run(c: dict[str, list]):
        enc = encoding(*sent.value)
        yield {key: c["k"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in c["t"]]}

    return arrow_map(df.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"`{key}` {kind}, n_tokens int")


def packed(
    df: DataFrame,
    key: str,
    text: str,
    capacity: int = CAPACITY,
    max_documents: int = MAX_DOCUMENTS,
    max_cost: float | None = None,
    tokenizer: str = TOKENIZER,
    group: int = GROUP,
) -> DataFrame:
    """(key, part_no, token_start, n_tokens, container_id): where each text, or each part of a longer one, is put.

    max_cost: capacity for the sum of squared sizes in a container of several documents; by default MAX_COST_PART of the
    square of the capacity.
    """
    kind = dict(df.dtypes)[key]
    most = MAX_COST_PART * float(capacity) ** 2 if max_cost is None else float(max_cost)
    groups = max(1, -(-df.count() // group))  # rows only: parquet answers from its footers
    sized = measured(df, key, text, tokenizer)
    parts = sized.select(
        F.col(key), F.col("n_tokens").alias("all"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1))).alias("part_no")
    ).select(
        F.col(key),
        "part_no",
        (F.col("part_no") * capacity).alias("token_start"),
        F.least(F.lit(capacity), F.col("all") - F.col("part_no") * capacity).alias("n_tokens"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(groups)).alias("bin_group"),
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", key, "part_no"], ascending=[False, True, True], kind="stable")
        full = pdf["n_tokens"].to_numpy() > 0
        name = np.full(len(pdf), None, object)
        if full.any():
            where = best_fit(pdf["n_tokens"].to_numpy()[full], capacity, max_documents, most)
            g = int(pdf["bin_group"].iloc[0])
            name[full] = [f"{g}-{w}" for w in where]
        return pd.DataFrame({key: pdf[key], "part_no": pdf["part_no"], "token_start": pdf["token_start"], "n_tokens": pdf["n_tokens"], "container_id": name})

    # a number of partitions of its own: small rows would otherwise be merged into one task
    spread = parts.repartition(max(1, -(-groups // GROUPS_A_TASK)), "bin_group")
    return spread.groupBy("bin_group").applyInPandas(pack, f"`{key}` {kind}, part_no int, token_start int, n_tokens int, container_id string")


def fill(packing: DataFrame, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, max_cost: float | None = None) -> DataFrame:
    """(containers, documents, token_fill, document_fill, cost_fill, full_by_documents, full_by_cost) of a packing.

    The fills are mean parts of the capacities; full_by_documents and full_by_cost count the containers with room for
    tokens that their number or cost keeps shut (a twentieth of the token capacity or more is left). An empty packing
    gives one row of nulls and zeros.
    """
    most = MAX_COST_PART * float(capacity) ** 2 if max_cost is None else float(max_cost)
    size = F.col("n_tokens").cast("double")
    each = packing.filter("container_id is not null").groupBy("container_id").agg(F.sum(size).alias("t"), F.count("*").alias("d"), F.sum(size * size).alias("c"))
    room = F.col("t") <= 0.95 * capacity
    return each.agg(
        F.count("*").alias("containers"), F.sum("d").alias("documents"), F.avg(F.col("t") / capacity).alias("token_fill"), F.avg(F.col("d") / max_documents).alias("document_fill"),
        F.avg(F.least(F.lit(1.0), F.col("c") / most)).alias("cost_fill"), F.count_if(room & (F.col("d") >= max_documents)).alias("full_by_documents"),
        F.count_if(room & (F.col("c") > 0.95 * most)).alias("full_by_cost"),
    )
