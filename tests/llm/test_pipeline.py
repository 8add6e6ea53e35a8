"""The pipeline end to end on odd tables: its stages' decisions by brute force."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, bins string, _score string, sig string"
LABEL = "doc_id bigint, quality int, toxic int"


def folder(spark, path, rows, labels):
    full = [(i, t, "en", "s", None if t is None else len(t), 1, "b", "s", None) for i, t in rows]
    spark.createDataFrame(full, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABEL).write.parquet(f"{path}/labels.parquet")
    return str(path)


def words(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, copies, a shared passage, toxic rows and extra columns."""
    rng = random.Random(9)
    clean = [(i, words(rng, 40)) for i in range(200)]
    toxic = [(1000 + i, words(rng, 20) + " idiotscum " + words(rng, 20)) for i in range(100)]
    passage = words(rng, 60)
    extra = [(500, clean[3][1]), (501, clean[4][1].replace(" ", "  ")), (502, words(rng, 30) + " " + passage), (503, passage + " " + words(rng, 30)),
             (504, None), (505, ""), (506, " \n"), (7, clean[7][1]), (None, words(rng, 25)), (None, None)]
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 0, 1) for i, _ in toxic] + [(None, 1, 1), (3, None, None)]
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, clean + toxic + extra, labels)).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "packing"]
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
    kept = set(pieces)
    assert not kept & {i for i, _ in toxic}, "toxic rows go"
    assert {i for i, _ in clean} <= kept and 500 not in kept and 501 not in kept, "one of each group of copies stays"
    assert {502, 503, 504, 505, 506, None} <= kept
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda text: np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()
    joined = {i: b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start)) for i, own in pieces.items() if i is not None}
    texts = dict(clean + extra)
    for i in (0, 1, 3, 7, 502):
        assert joined[i] == ids(texts[i])
    # The passage stays where it stands first.
    assert joined[503] == ids(" ".join(texts[503].split()[60:]))
    assert joined[504] == joined[505] == joined[506] == ids("")
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_pipeline_on_an_empty_table(spark, tmp_path, labels):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], labels)).collect() == []
