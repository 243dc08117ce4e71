"""Small fixtures and whole-table readers shared by the tests of the llm operators."""

from __future__ import annotations

import hashlib
import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def documents(spark, rows):
    """Documents from (doc_id, text), with columns whose names clash with those used inside."""
    data = [(i, t, "x", i, None, "y") for i, t in rows]
    return spark.createDataFrame(
        data, "doc_id bigint, text string, id string, n bigint, mark bigint, _group string"
    ).repartition(3)


def written(spark, tmp_path, name, df):
    """A table folder as the queries read it."""
    path = str(tmp_path / "tables")
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return path


def passages(seed: int, docs: int = 60):
    """Texts that share passages of many lengths, with copies, edits, loops, nulls and odd spaces."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(40)}é" if rng.random() < 0.1 else f"w{rng.randrange(300)}" for _ in range(400)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(5, 60))] for _ in range(8)]
    out = []
    for i in range(docs):
        kind = rng.random()
        if kind < 0.05:
            out.append((i, None if rng.random() < 0.5 else ""))
        elif kind < 0.15 and out:
            out.append((i, rng.choice(out)[1]))
        elif kind < 0.2:
            out.append((i, " ".join(["loop", "la"] * rng.randrange(3, 120))))
        else:
            body = []
            for _ in range(rng.randrange(1, 5)):
                body += [rng.choice(words) for _ in range(rng.randrange(0, 40))]
                body += rng.choice(shared)[rng.randrange(4) :]
            out.append((i, rng.choice([" ", "\n", "\t", "  "]).join(body)))
    return out
