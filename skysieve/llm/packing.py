"""Filling fixed-capacity containers with texts measured in tokens (best-two-fit)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysieve.llm.bpe import DEFAULT_VOCABULARY, count_tokens
from skysieve.session import stored

#: Items that one task packs together. More of them leave fewer part-filled last containers; at 20,000 items those are under
#: one in a thousand.
SHARD_ITEMS = 20_000


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (1 <= size <= capacity).

    Containers are filled greedily, largest item that still fits first. Where that leaves a gap, the smallest item of the
    container goes back if two unpacked items together fit the gap so widened more tightly, and the tightest such pair takes its
    place. The sizes still unpacked are the set bits of one integer, so the largest that fits is a bit operation."""
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        stacks.setdefault(int(sizes[i]), []).append(i)
    left = 0
    for s in stacks:
        left |= 1 << s
    out = np.empty(len(sizes), dtype=np.int64)
    number = 0

    def take(s: int) -> int:
        nonlocal left
        stack = stacks[s]
        item = stack.pop()
        if not stack:
            left ^= 1 << s
        return item

    while left:
        gap, held = capacity, []
        while gap and (fits := left & ((1 << (gap + 1)) - 1)):
            s = fits.bit_length() - 1
            held.append((take(s), s))
            gap -= s
        if gap and left:
            last, least = held[-1]
            wide, best, pair = gap + least, least, None
            below = left & ((1 << wide) - 1)
            while below:
                a = below.bit_length() - 1
                if 2 * a <= best:
                    break
                rest = min(wide - a, a)
                partners = left & ((1 << (rest + 1)) - 1)
                if rest == a and len(stacks[a]) < 2:
                    partners &= ~(1 << a)
                b = partners.bit_length() - 1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == wide:
                        break
                below ^= 1 << a
            if pair:
                held.pop()
                if not stacks[least]:
                    left |= 1 << least
                stacks[least].append(last)
                held += [(take(s), s) for s in pair]
        for item, _ in held:
            out[item] = number
        number += 1
    return out


def _pack(items: pd.DataFrame) -> pd.DataFrame:
    numbers = best_two_fit(items["n_tokens"].to_numpy(), int(items["capacity_tokens"].iloc[0]))
    name = f"{items['container_kind'].iloc[0]}/{items['shard'].iloc[0]}/"
    items["container_id"] = [name + str(n) for n in numbers]
    return items.drop(columns=["shard"])


def pack_texts(documents: DataFrame, containers: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """container_kind, container_id, `key`, piece_no, token_start, n_tokens: where the tokens of every text lie, for each
    kind of container (container_kind, capacity_tokens; a fixed, small table; kinds without a positive capacity are left out).

    A text longer than the capacity fills whole containers of its own and its rest is packed like any other text; no other
    text is cut. Items are spread over shards of about shard_items by a hash of their row, so equal texts and
    ids do not crowd one shard, and each shard is packed by one task. Null and empty texts, of 0 tokens, are in no
    container: one row with container_id null. Repeated rows are packed once each."""
    kinds = [(r["container_kind"], int(r["capacity_tokens"])) for r in containers.filter("capacity_tokens > 0 and container_kind is not null").distinct().collect()]
    sizes = stored(count_tokens(documents, vocabulary_path, key, text).withColumn("row_no", F.monotonically_increasing_id()), "token-counts")
    shards = max(1, -(-sizes.filter("n_tokens > 0").count() // shard_items))
    spec = F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity_tokens")) for k, c in sorted(kinds))) if kinds else F.array().cast("array<struct<container_kind:string,capacity_tokens:int>>")
    each = sizes.select(key, "row_no", F.col("n_tokens").alias("total"), F.explode(spec).alias("s")).select(key, "row_no", "total", "s.*")
    whole = F.when(F.col("total") > F.col("capacity_tokens"), F.floor(F.col("total") / F.col("capacity_tokens")).cast("int")).otherwise(0)
    each = each.withColumn("whole", whole).withColumn("rest", (F.col("total") - F.col("whole") * F.col("capacity_tokens")).cast("int"))
    full = (
        each.filter("whole > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
        .select("container_kind", F.concat_ws("/", "container_kind", F.lit("row"), "row_no", "piece_no").alias("container_id"), key, "piece_no", (F.col("piece_no") * F.col("capacity_tokens")).alias("token_start"), F.col("capacity_tokens").alias("n_tokens"))
    )
    empty = each.filter("total = 0").select("container_kind", F.lit(None).cast("string").alias("container_id"), key, F.lit(0).alias("piece_no"), F.lit(0).alias("token_start"), F.lit(0).alias("n_tokens"))
    items = each.filter("rest > 0").select(
        "container_kind", "capacity_tokens", F.pmod(F.xxhash64("row_no"), F.lit(shards)).cast("int").alias("shard"), key,
        F.col("whole").alias("piece_no"), (F.col("whole") * F.col("capacity_tokens")).alias("token_start"), F.col("rest").alias("n_tokens"),
    )
    kind = documents.schema[key].dataType.simpleString()
    packed = items.groupBy("container_kind", "shard").applyInPandas(
        _pack, f"container_kind string, capacity_tokens int, {key} {kind}, piece_no int, token_start int, n_tokens int, container_id string"
    )
    return packed.select("container_kind", "container_id", key, "piece_no", "token_start", "n_tokens").unionByName(full).unionByName(empty)
