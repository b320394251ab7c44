"""The pipeline's rows against its five stages done one document after the other."""

import re
from collections import Counter

import pandas as pd
import sentencepiece

from stagesignal.llm import langid, mixing
from stagesignal.llm.queries import MODEL_FILE
from tests.llm.test_brute_force import plain_targets
from tests.llm.test_text_operators import brute_print, words


def test_pipeline_is_that_of_a_plain_walk(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(docs.where(~langid.held_out("doc_id", 5, 0)))
    rows = {r["doc_id"]: r for r in docs.collect()}
    accepted = model.predict(pd.Series([r["text"] for r in rows.values()]))["accepted"].tolist()
    left = [i for i, ok in zip(rows, accepted) if ok]

    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"]), i)
    left = sorted(first.values())

    prints, group = {i: brute_print(rows[i]["text"]) for i in left}, {}
    for i in left:  # the smallest of what i links to, and all of their groups
        near = {group[j] for j in group if (prints[i] ^ prints[j]).bit_count() <= 4}
        least = min(near, default=i)
        group = {j: least if g in near else g for j, g in group.items()} | {i: least}
    left = sorted(set(group.values()))

    kept = docs.where(docs["doc_id"].isin(left))
    keys = {r["_id"]: r["_key"] for r in mixing._base(kept, "doc_id", "text", "source", 7).collect()}
    size = {i: words(rows[i]["text"]) for i in left}
    sizes = Counter()
    for i in left:
        sizes[rows[i]["source"]] += size[i]
    copies = Counter()
    for source, target in plain_targets(dict(sizes)).items():
        epochs, done = int(target // sizes[source]), 0
        rest = target - epochs * sizes[source]
        for i in sorted((i for i in left if rows[i]["source"] == source), key=lambda i: (keys[i], i)):
            copies[i] = epochs + (done + size[i] / 2 < rest)
            done += size[i]

    coder = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    wanted = Counter({(i, tuple(coder.encode(rows[i]["text"]))): n for i, n in copies.items() if n})
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == wanted and len(left) > 100
