"""The pipeline against a brute-force version of its stages."""

import hashlib
import sys
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from loanscope.llm import queries, tiling  # noqa: E402
from test_llm_operators import ROWS, brute_components, greedy_tiles, near_copies, raw  # noqa: E402

SF = "/root/testdata/sf0.001"


def cut_repeats(docs):
    seen, out = set(), []
    for i, t in sorted(docs):
        b = raw(t)
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        if any(gone):
            t = bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore")
            if not t.encode().split():
                continue
        out.append((i, t))
    return out


def test_run_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    told = {r.doc_id: r for r in queries.op4_language(spark, SF).collect()}
    docs = [(i, t) for i, t in docs if told[i].lang_pred != "und" and told[i].score >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    root = {i: c for i, _, c in brute_components(docs, corpus_pipeline.NEAR_PERCENT, corpus_pipeline.NEAR_WORDS)}
    docs = cut_repeats([(i, t) for i, t in docs if root[i] == i])
    items = [tiling.tokens_of([raw(t)])[0].tolist() for _, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    clean = []
    for i, t in docs:
        tokens = tiling.tokens_of([raw(t)])[0].tolist()
        grams = {tuple(tokens[k:k + 5]) for k in range(len(tokens) - 4)}
        near = [x for x in items if sum(tuple(x[k:k + 5]) in grams for k in range(len(x) - 4)) >= 0.2 * len(x)]
        if not any(sum(m[2] for m in greedy_tiles(x, tokens, 5)) >= 0.6 * len(x) for x in near):
            clean.append((i, t))
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: hashlib.sha256(" ".join(map(str, lib.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t in clean}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == want


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages_keep_columns_and_take_any_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or ""), i, "x", i, 1, 2.0, "y") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, k long, root string, __k long, __h0 int, __score double, __blank string").repartition(2)
    n = len(rows)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() <= n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n and "ids_sha256" in last.columns


def test_near_duplicates_keep_one_of_each_group_and_all_empty_texts(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (9, ""), (9, ""), (None, None),
            (None, "only null here now ok"), (None, "only null here now ok"), (11, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=repr)
    assert kept == sorted([(3, "a b c d e f g"), (9, ""), (9, ""), (None, None), (None, "only null here now ok"), (11, "q")], key=repr)


def test_repeats_cuts_texts_and_drops_emptied_ones(spark):
    a = "".join(map(chr, range(0x100, 0x13C)))  # 120 bytes, no string twice
    docs = spark.createDataFrame([(1, a + " one", 64), (2, "two " + a, 64), (3, a, 60), (4, None, None), (5, "short", 5)], "doc_id long, text string, n_chars int")
    kept = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeats(spark, docs, SF).collect()}
    assert kept == {1: (a + " one", 64), 2: ("two ", 4), 4: (None, None), 5: ("short", 5)}


def test_near_duplicates_share_four_fifths_of_five_word_shingles(spark):
    words = [f"w{i}" for i in range(50)]
    changed = [*words[:25], "new", *words[26:]]
    # 41 of 51 five-word shingles (0.804) and 43 of 51 four-word ones (0.843).
    rows = [(500, " ".join(words)), (501, " ".join(changed)), *((600 + i, t) for i, t in near_copies())]
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = {min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert 501 not in kept and sorted(kept) == sorted(want)
