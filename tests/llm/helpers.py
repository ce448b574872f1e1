"""Small inputs and brute-force forms the operator tests share."""

import random

LONG = " ".join(f"w{i % 701}x{i % 13}" for i in range(30_000))

#: Nulls, empty and blank texts, a very long text, ties and a repeated row; ``score`` and others
#: clash with the operators' own column names.
ODD = [(1, "one two three four five six"), (1, "one two three four five six"), (2, ""), (3, None),
       (None, "no id here at all"), (4, "   \n\t "), (5, LONG), (6, "Übung macht den Meister ñandú 日本語 😀"),
       (7, "one"), (8, "x" * 50_000)]


def odd_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for name in ("score", "kept", "words", "class", "u", "d", "k", "node", "template", "h", "_terms", "n_words"):
        df = df.withColumn(name, F.lit(name))
    return df


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(0, size)}" for _ in range(n)]


def components(edges: list[tuple], nodes: list) -> dict:
    """Smallest reachable node, by union-find."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}
