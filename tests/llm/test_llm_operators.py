"""Text operators against brute force, libraries and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from loanscope.llm import bpe, brown, jaccard, langid, lines, quality, queries, rindex, tiling, tokenfile, viterbi
from loanscope.llm.common import mix64

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = "the of and tion ing er le des und der die que los ento a in".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, repeated rows and ids, nulls, empties, junk and a long text."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(3, 160)) for _ in range(12)]
    passage = sentence(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12, 24):
        words = base[i % 12].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(30, base[0]), (31, base[0]), (31, base[0]), (None, base[1]), (None, None), (32, None), (33, ""), (34, " \n\t "),
             (35, sentence(rng, 20) + "\n" + passage + "\n" + sentence(rng, 9)), (36, passage + "\n" + sentence(rng, 30)),
             (37, "x"), (38, "x"), (39, "-" * 400), (40, "ab " * 300), (41, "é日本語 ÀÉ ß " * 30), (42, "0 1 2 !! ??"),
             (43, sentence(rng, 30_000)), (44, base[3] + "\n" + base[4]), (44, base[5]), (45, "a b c\x1c\x85 d\x00e"), (46, "W" * 30_000)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    """The corpus with further columns whose names operators use inside."""
    rows = [(i, t, "en" if k % 3 else None, k, "z", 1.5) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, k int, items string, score double").repartition(3)


def empty(docs):
    return docs.filter("false")


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def raw(t):
    return (t or "").encode()


# --- 1 -----------------------------------------------------------------------

def test_brown_counts_base_score_and_probabilities(spark, docs):
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in ROWS]
    texts = [raw(t).lower().split() + [b"\n"] for _, t in ROWS]
    c = Counter(w for t, h in zip(texts, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = [(i, h, len(t), sum(c[w] > 0 for w in t), n, round(float(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)), 6))
            for (i, _), h, t in zip(ROWS, held, texts)]
    rows = brown.score(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in rows)
    assert brown.score(empty(docs)).collect() == []


def test_brown_model_is_a_distribution():
    rng = np.random.default_rng(1)
    wide = brown.CLASSES + 1
    own = np.concatenate((rng.integers(0, 5, 40), [brown.CLASSES]))  # class of each type, the end token last
    c = np.concatenate((rng.integers(1, 4, 40), [20]))
    transitions = np.zeros((wide, wide))
    seq = rng.permutation(np.repeat(own, c))
    np.add.at(transitions, (np.concatenate(([brown.CLASSES], seq[:-1])), seq), 1)
    once = np.bincount(own[c == 1], minlength=wide)
    m = brown.Model(transitions, once, int(c.sum()), len(c))
    for before in (0, 3, brown.CLASSES):
        p = sum(10 ** m.log10(np.array([1, k]), np.array([before, o]), np.array([0]))[1] for k, o in zip(c, own))
        p += 10 ** m.log10(np.array([1, 0]), np.array([before, -1]), np.array([0]))[1]
        assert abs(p - 1) < 1e-9


def test_brown_beats_the_base_on_held_out_texts(spark):
    r = queries.op1_brown(spark, SF).groupBy("held_out").sum("score", "base_score").collect()
    assert {x.held_out for x in r} == {True, False}
    assert all(x["sum(score)"] > x["sum(base_score)"] for x in r)


def test_brown_tells_more_than_64_contexts_apart(spark):
    rng = random.Random(12)
    ring = [f"w{i}" for i in range(110)]  # each word follows one other word only
    rows = []
    for i in range(400):
        at = rng.randrange(110)
        rows.append((i, " ".join(ring[(at + k) % 110] for k in range(60))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    r = brown.score(df).filter("held_out").groupBy().sum("score", "n_tokens").first()
    assert r["sum(score)"] / r["sum(n_tokens)"] > -0.3


@pytest.mark.parametrize("candidates, finalists", [(4096, 1024), (260, 1024), (20, 1024), (260, 130)])
def test_brown_contexts_are_the_most_frequent_words_of_all_blocks(spark, monkeypatch, candidates, finalists):
    from pyspark.sql import functions as F
    monkeypatch.setattr(brown, "CANDIDATES", candidates)
    monkeypatch.setattr(brown, "FINALISTS", finalists)
    rng = random.Random(31)
    rows = []
    for i in range(4):  # each block has its own frequent words; those of all blocks are in the middle of each
        words = [f"own{i}x{k}" for k in range(90) for _ in range(40 + k % 7)]
        words += [f"all{k}" for k in range(90) for _ in range(20 + (k + 3 * i) % 11)]
        words += [f"rare{i}x{k}" for k in range(300)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    counts = Counter(w.encode() for _, t in rows for w in t.split())
    want = sorted(counts, key=lambda w: (-counts[w], w))[:brown.CONTEXTS - 1]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False)).repartition(4, "doc_id")
    assert brown.context_words(brown.blocks(df)) == want
    assert brown.context_words(brown.blocks(df.withColumn("held_out", F.lit(True)))) == []


def test_brown_learns_nothing(spark, docs):
    from pyspark.sql import functions as F
    rows = brown.score(docs, held_out=F.lit(True)).collect()
    assert len(rows) == len(ROWS) and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in rows)


# --- 2 -----------------------------------------------------------------------

def greedy_tiles(item, doc, least):
    """String tiling by definition: longest unmarked common run first, by item then document position."""
    fi, fd, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while p + n < len(item) and d + n < len(doc) and item[p + n] == doc[d + n] and fi[p + n] and fd[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, d)
        n, p, d = best
        if n < least:
            return out
        fi[p:p + n], fd[d:d + n] = [False] * n, [False] * n
        out.append((p, d, n))


def test_tiles_equal_the_definition():
    rng = random.Random(2)
    for _ in range(300):
        item, doc = ([rng.randrange(4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert tiling.tile(np.array(item, np.uint64), np.array(doc, np.uint64), 2) == greedy_tiles(item, doc, 2)


def test_decontamination_finds_reordered_and_whole_items(spark, docs):
    rng = random.Random(9)
    a, b = (" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(30)) for _ in range(2))
    bench = spark.createDataFrame([(7, a), (8, b), (9, "too short"), (None, None), (10, a)], "item_id long, text string")
    w = a.upper().split()
    extra = spark.createDataFrame([(100, "x " + a + " y"), (101, ", ".join(w[20:] + ["zz"] + w[:10] + ["zz"] + w[10:20])),
                                   (102, " ".join(a.split()[:12]) + " q"), (103, b + " " + a)], "doc_id long, text string")
    out = tiling.contaminated(docs.select("doc_id", "text").union(extra), bench)
    assert got(out.filter("contaminated"), "doc_id", "item_ids") == sorted([(100, [7, 10]), (101, [7, 10]), (103, [7, 8, 10])], key=repr)
    assert out.count() == len(ROWS) + 4
    tiles = {r.doc_id: r["items"] for r in tiling.matches(extra, bench).collect()}
    assert (b + " " + a).encode()[tiles[103][0].tiles[0].start:tiles[103][0].tiles[0].end].decode() == a
    assert tiling.contaminated(empty(docs), bench).collect() == []
    assert tiling.contaminated(extra, bench.filter("false")).filter("contaminated").count() == 0
    assert tiling.clean_rows(docs, bench).columns == docs.columns


def test_batches_with_and_without_items_go_together(spark):
    a = " ".join(f"w{k}" for k in range(30))
    d = spark.range(5000, numPartitions=1).selectExpr("id AS doc_id", f"CASE WHEN id IN (1500, 3100) THEN '{a}' ELSE 'clean' END AS text")
    bench = spark.createDataFrame([(7, a)], "item_id long, text string")
    assert got(tiling.contaminated(d, bench).filter("contaminated"), "doc_id") == [(1500,), (3100,)]
    assert tiling.clean_rows(d, bench).count() == 4998


def test_decontamination_in_slices_is_the_same(spark, monkeypatch):
    from loanscope.llm.common import documents
    d, bench = documents(spark, SF), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = got(tiling.contaminated(d, bench), "doc_id", "contaminated", "coverage", "item_ids")
    monkeypatch.setattr(tiling, "SLICE_BYTES", 3000)
    assert got(tiling.contaminated(d, bench), "doc_id", "contaminated", "coverage", "item_ids") == whole
    items = [(i, tiling.tokens_of([raw(t)])[0].tolist()) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    held = defaultdict(list)
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE doc_id % 4 = 0").fetchall():
        tokens = tiling.tokens_of([raw(text)])[0].tolist()[:3000]
        grams = {tuple(tokens[k:k + 5]) for k in range(len(tokens) - 4)}
        for i, item in items:
            if sum(tuple(item[k:k + 5]) in grams for k in range(len(item) - 4)) and len(tokens) < 3000:
                if sum(t[2] for t in greedy_tiles(item, tokens, 5)) >= 0.6 * len(item):
                    held[doc_id].append(i)
    assert {r[0]: r[3] for r in whole if r[0] in held} == dict(held)


# --- 3, 6, 9 -----------------------------------------------------------------

def strange_texts():
    rng = random.Random(4)
    out = [t or "" for _, t in ROWS if t is None or len(t) < 20_000]
    out += ["<|endoftext|>x <|startoftext|>", "don't WE'LL İstanbul ΣΑΣ é  x", "▁▁a ▁ b▁c", "<0x0A> <s> </s> <unk>", "a" * 3000, "=" * 200]
    out += ["".join(rng.choice("aab'<|>é \n\t日!!=1") for _ in range(50)) for _ in range(150)]
    return out + ["".join(chr(rng.choice([rng.randint(1, 0x2ff), rng.randint(0x300, 0x3000)])) for _ in range(30)) for _ in range(150)]


def test_count_equals_the_unigram_tokenizer(spark, docs):
    lib = Tokenizer(models.Unigram(viterbi.read_vocabulary(PIECES), unk_id=0, byte_fallback=True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(split=True, prepend_scheme="first")
    counter = viterbi.load(PIECES)
    for t in strange_texts():
        assert counter.count(t.encode())[0] == len(lib.encode(t).ids), t
    out = got(viterbi.count_tokens(docs, PIECES), "doc_id", "n_tokens", "n_bytes")
    assert out == sorted(((i, len(lib.encode(t or "").ids), len(raw(t))) for i, t in ROWS), key=repr)
    assert viterbi.count_tokens(empty(docs), PIECES).collect() == []


def test_ties_go_to_the_longer_last_piece():
    v = viterbi.CountingViterbi([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)])
    lib = Tokenizer(models.Unigram([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)], unk_id=0))
    for n in range(1, 8):
        assert v.best("▁" + "a" * n)[0] == len(lib.encode("▁" + "a" * n).ids)


def test_bpe_equals_the_library(spark, docs):
    lib = Tokenizer.from_file(BPE)
    lib.no_truncation()
    lib.no_padding()
    own = bpe.load(BPE)
    for t in strange_texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False), t
    want = []
    for i, t in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got(bpe.encode_documents(docs, BPE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.encode_documents(empty(docs), BPE, with_ids=True).collect() == []


def test_cuts_lie_where_no_token_has_the_pair():
    own = bpe.load(BPE)
    assert all(t[i:i + 2] in own.inside for t in ("hello", "the") for i in range(len(t) - 1))
    word = "xqzjvvwq" * 5
    assert "".join(own.cut(word)) == word + own.suffix and len(own.cut(word)) > 1


def test_long_and_short_merges_agree(monkeypatch):
    own = bpe.ForcedBoundaryBPE(BPE)
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinorstth") for _ in range(rng.randint(2, 60))) for _ in range(300)]
    short = [own._merge(w + own.suffix) for w in words]
    monkeypatch.setattr(bpe, "SCAN_LENGTH", 0)
    assert [own._merge(w + own.suffix) for w in words] == short


def test_bpe_holds_a_word_once(monkeypatch):
    own = bpe.ForcedBoundaryBPE(BPE)
    text = "alpha, Alpha beta ALPHA. don't béta béta, <unk> alpha<unk> x1"
    assert own.encode(text) == Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids
    assert not {"alpha", "beta", "don"} & own.words.keys() and {b"alpha", b"beta", b"don"} <= own.chunks.keys()
    assert all(type(v) is bytes for v in [*own.words.values(), *own.chunks.values()])
    assert own.chunks[b"Alpha"] is own.chunks[b"alpha"]
    for text in ("", "\x00 \x00", "\xff ÿ\xff", "PAD pad <s>pad</s>"):
        assert own.encode(text) == Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def test_workers_of_text_stages_give_memory_back(spark, docs, monkeypatch):
    lean, given = bpe.lean, []
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    for module in (bpe, tiling, rindex):
        monkeypatch.setattr(module, "lean", lambda step: given.append(step) or lean(step))
    bpe.encode_documents(docs, BPE)
    tiling.contaminated(docs, bench)
    assert [f.__name__ for f in given] == ["encode", "scan"]
    plan = rindex.remove_repeats(docs)._jdf.queryExecution().analyzed().toString()
    # every step over rows but the sample's, which has ended by then
    assert plan.count("MapInArrow") == len([f for f in given[2:] if f.__name__ != "cut"])


def test_words_of_token_files_serve_the_next_task(spark, tmp_path, monkeypatch):
    def watched(path):
        enc = tokenfile.ChunkEncoder(path)

        def forget():
            raise AssertionError("words are forgotten between tasks")

        enc.words.forget = forget
        return enc

    monkeypatch.setattr(tokenfile, "encoder", watched)
    rows = [(i, f"alpha beta-{i} gamma") for i in range(6)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    manifest = tokenfile.write_tokens(made, BPE, f"file://{tmp_path}/ids")
    assert [r.n_docs for r in manifest.collect()] == [6]


def test_token_files_round_trip(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 4000)
    lib = Tokenizer.from_file(BPE)
    folder = str(tmp_path / "ids")
    manifest = tokenfile.write_tokens(docs, BPE, folder)
    assert manifest.count() > 2
    out = tokenfile.read_tokens(spark, folder).collect()
    texts = defaultdict(list)
    for i, t in ROWS:
        texts[i].append(np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((i, len(x) // 4, zlib.crc32(x)) for i, xs in texts.items() for x in xs)
    ordered = sorted(out, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    keys = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert keys == sorted(keys)
    found = [x for s in manifest.collect() if (x := tokenfile.Shard(folder, s.shard).find(30)) is not None]
    assert len(found) == 1 and found[0].astype("<u4").tobytes() == texts[30][0]
    assert tokenfile.read_tokens(spark, (tokenfile.write_tokens(empty(docs), BPE, str(tmp_path / "none")), str(tmp_path / "none"))[1]).collect() == []


# --- 4 -----------------------------------------------------------------------

def test_gradients_agree_with_differences():
    net = langid.ByteGRU(["a", "b", "c"], seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, lengths = langid._padded([b"abc", b"de", b"xyzzy"])
    target, weight = np.array([0, 2, 1]), np.array([1.0, 2.0, 0.5])

    def loss():
        probs = net._forward(rows, lengths)[0].astype(np.float64)
        share = (np.arange(rows.shape[1]) < lengths[:, None]) * weight[:, None]
        return -(np.log(probs[np.arange(3), :, target]) * share).sum() / share.sum()

    grads = net._gradients(rows, lengths, target, weight)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        for _ in range(4):
            at = (ord("b"), rng.integers(g.shape[1])) if name == "embed" else tuple(rng.integers(s) for s in g.shape)
            old = net.p[name][at]
            net.p[name][at] = old + 1e-3
            up = loss()
            net.p[name][at] = old - 1e-3
            down = loss()
            net.p[name][at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-4, name


def test_language_accuracy_on_held_out_documents(spark):
    out = queries.op4_language(spark, "/root/testdata/sf0.01").collect()
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in out if r.held_out]
    assert len(out) == len(lang) and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_cases(spark, docs):
    learn = spark.createDataFrame([(1, "the of and that with " * 9, "en"), (2, "le des une été pour " * 9, "fr"), (3, None, "en"), (4, "x", None)],
                                  "doc_id long, text string, lang string")
    model = langid.train(learn)
    assert model.languages == ["en", "fr"]
    out = langid.predict(docs, model)
    assert out.columns[:-2] == docs.columns[:-1] + ["score"] or set(docs.columns) <= set(out.columns)
    rows = langid.predict(docs, model, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert {r.lang_pred for r in langid.predict(docs, langid.train(empty(learn)), keep=["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty(docs), model, keep=["doc_id"]).collect() == []
    assert "".join(x[2] for x in model.label_positions("the été")).count("fr") >= 1


# --- 5 -----------------------------------------------------------------------

def shingles(text, words=4):
    w = raw(text).lower().split()
    return {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute_components(rows, percent=85, words=4):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    best = {k: min([v for v in vs if v is not None], default=None) for k, vs in least.items()}
    return sorted(((rows[i][0], len(sets[i]), best[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=repr)


def near_copies():
    rng = random.Random(8)
    rows = []
    for g in range(6):
        words = [f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
            rows.append((len(rows) * 3 % 101, " ".join(copy)))
    return rows


@pytest.mark.parametrize("size", [1024, 2])
def test_jaccard_components_equal_brute_force(spark, docs, monkeypatch, size):
    monkeypatch.setattr(jaccard, "LIST", size)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(jaccard.components(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    if size > 2:
        assert got(jaccard.components(docs), "doc_id", "n_shingles", "component_id") == brute_components(ROWS)
        assert jaccard.components(empty(docs)).collect() == []


def test_bounds_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 3000))
        a = np.unique(mix64(rng.integers(0, 2 ** 63, n).astype(np.uint64)))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.95], mix64(rng.integers(0, 2 ** 63, max(1, n // 30)).astype(np.uint64)))))
        x, y = (np.frombuffer(jaccard.bitmap(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        far = np.bitwise_count(jaccard.fold(x, size) ^ jaccard.fold(y, size)).sum()
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert jaccard.may_link(np.array([len(a)]), np.array([len(b)]), np.array([far]), 85)[0]


# --- 7 -----------------------------------------------------------------------

def base_figures(text):
    words = raw(text).split()
    win = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if win[tuple(words[k:k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in raw(text).split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_base_figures(spark, docs):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = quality.judge(docs)
    assert got(out, *cols) == sorted(((i, *base_figures(t)) for i, t in ROWS), key=repr)
    assert out.filter("base_failed and kept").count() == 0
    assert quality.judge(empty(docs)).collect() == []


def test_kneser_ney_sums_to_one_and_equals_a_plain_model():
    texts = [t.encode() for _, t in ROWS[:20] if t]
    codes = np.concatenate([c for c, _ in quality.codes_of(texts)])
    plain = Counter()
    for t in texts:
        s = [quality._START] * 3 + [int(quality.CLASSES[b]) for b in t] + [quality._START]
        plain.update(((a * 40 + b) * 40 + c) * 40 + d for a, b, c, d in zip(s, s[1:], s[2:], s[3:]))
    found, n = np.unique(codes, return_counts=True)
    assert dict(zip(found.tolist(), n.tolist())) == dict(plain)
    keys, values = quality.kneser_ney(found, n)
    assert (np.diff(keys.astype(object)) > 0).all()
    p = 10 ** quality.look_up(keys, values)
    for context in found[:5] // quality.ALPHABET:
        seen = found[found // quality.ALPHABET == context]
        assert 0 < p[seen].sum() <= 1 + 1e-9


def plain_levels(texts):
    """Negative mean log10 probability per byte under the Kneser-Ney model of all bytes, by definition."""
    padded = [b"\n\n\n" + t + b"\n" for t in texts]
    grams = {4: Counter(t[k:k + 4] for t in padded for k in range(len(t) - 3))}
    for n in (3, 2, 1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    lower = defaultdict(lambda: 1 / 256)
    for n in (1, 2, 3, 4):
        n1, n2, n3, n4 = (max(1, sum(c == k for c in grams[n].values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [0, max(0.05, min(0.95, 1 - 2 * y * n2 / n1)), max(0.05, min(1.9, 2 - 3 * y * n3 / n2)), max(0.05, min(2.85, 3 - 4 * y * n4 / n3))]
        total, off = Counter(), Counter()
        for g, c in grams[n].items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3)]
        lower = {g: (c - d[min(c, 3)]) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * (lower[b""] if n == 1 else lower[g[1:]]) for g, c in grams[n].items()}
    return [-sum(np.log10(lower[t[k:k + 4]]) for k in range(len(t) - 3)) / (len(t) - 3) for t in padded]


@pytest.mark.parametrize("common", [quality.COMMON, 300, 0])
def test_quality_model_tells_every_byte_apart_with_any_number_of_common_ngrams(spark, common):
    # letters by case, digits and the bytes from 128 on were not told apart: the last rows' levels were those of their twins
    rows = [(i, t) for i, t in ROWS if t is None or len(t) < 3000]
    rows += [(50, "1 2 3 4 " * 5), (51, "1 1 1 1 " * 5), (52, "AB Ab aB ab"), (53, "ab ab ab ab"), (54, "\u0440\u0447 " * 9), (55, "\u0440\u0440 " * 9)]
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    want = sorted(((i, round(float(x), 9)) for (i, _), x in zip(rows, plain_levels([raw(t) for _, t in rows]))), key=repr)
    out = quality.measured_rows(quality.id_and_text(df, "doc_id", "text", "lang"), common)
    assert sorted(((r.doc_id, round(r.level, 9)) for r in out.collect()), key=repr) == want


def test_quality_counts_of_a_task_that_holds_few_ngrams(spark, docs, monkeypatch):
    texts = [raw(t) for _, t in ROWS]
    plain = Counter(int.from_bytes(t[k:k + 4]) for t in (b"\n\n\n" + x + b"\n" for x in texts) for k in range(len(t) - 3))
    for held in (quality.HELD, 40):
        monkeypatch.setattr(quality, "HELD", held)
        monkeypatch.setattr(quality, "BLOCK", 2000)
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
        told = Counter()
        for found in quality.counted_batches([batch]):
            for code, n in zip(*(c.to_pylist() for c in found.columns)):
                told[code] += n
        assert told == plain


# --- 8 -----------------------------------------------------------------------

def brute_removed(rows):
    """By definition over rows of (id, text), equal rows once; null ids first."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(raw(r[1])).hexdigest()))
    seen, out = set(), {}
    for i, t in order:
        t = raw(t)
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            w = t[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i, t] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *out[i, raw(t)]) for i, t in rows), key=repr)


def test_repeated_strings_equal_brute_force(spark, docs):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    norm = [(i, t or "") for i, t in ROWS]
    assert got(rindex.remove_repeats(docs), *cols) == brute_removed(norm)
    assert rindex.remove_repeats(empty(docs)).collect() == []


def test_hot_anchors_are_dealt_by_window(spark, docs, monkeypatch):
    monkeypatch.setattr(rindex, "SAMPLE", 1)
    monkeypatch.setattr(rindex, "HOT", 2)
    rng = random.Random(9)
    passage = bytes(rng.choice(b"abcdefgh") for _ in range(150))
    rows = [(i, (bytes(rng.choice(b"ijklmnop") for _ in range(80)) + passage + bytes(rng.choice(b"ijklmnop") for _ in range(80))).decode()) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(rindex.remove_repeats(df), *cols) == brute_removed(rows)
    assert got(rindex.remove_repeats(docs), *cols) == brute_removed([(i, t or "") for i, t in ROWS])
    hot = rindex.hot_anchors(df)
    assert 0 < len(hot) < 60
    batch = pa.RecordBatch.from_pylist([
        {"k": i, "d": 0, "later": None, "text": t, "spots": [{"d": 0, "spot": (int(a) << 16) | (int(b - a) << 8) | int(at - a)} for _, a, b, at, _ in zip(*rindex.anchored([raw(t)]))]}
        for i, t in rows])
    most = []
    for known in (frozenset(), hot):
        pieces = defaultdict(set)
        for out in rindex._segments(iter([batch]), known):
            for r in out.to_pylist():
                if r["piece"] is not None:
                    pieces[r["key"]].add(r["piece"])
        most.append(max(map(len, pieces.values())))
    assert most[0] > 100 and most[1] == 1  # distinct pieces that meet in one place


def test_every_window_has_one_anchor_that_its_content_gives():
    rng = random.Random(3)
    for trial in range(60):
        texts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcdefgh \n") for _ in range(rng.choice([0, 99, 100, 101, 400]))) for _ in range(4)]
        if trial % 5 == 0:
            texts.append(b"-" * 250)
        own, told = set(), {}
        for t, a, b, at, h in zip(*rindex.anchored(texts)):
            for w in range(a, b + 1):
                assert (t, w) not in own
                own.add((t, w))
                assert told.setdefault(texts[t][w:w + 100], (at - w, h)) == (at - w, h)
        assert len(own) == sum(max(0, len(t) - 99) for t in texts)


def test_run_index_equals_brute_force():
    rng = random.Random(6)
    for trial in range(150):
        size = rng.choice([3, 5, 8])
        strings = [bytes(rng.choice(b"ab\0" if trial % 3 == 0 else b"abc") for _ in range(rng.randint(size, 25))) for _ in range(rng.randint(1, 8))]
        index = rindex.RunIndex(strings + strings[:1])
        seen, want = set(), []
        for s in strings + strings[:1]:
            for i in range(len(s) + 1):
                w = s[i:i + size]
                want.append(len(w) == size and w in seen)
                if len(w) == size:
                    seen.add(w)
        assert index.repeated(size).tolist() == want and index.run_lengths.sum() == index.size


# --- 10 ----------------------------------------------------------------------

def brute_lines(rows, separator=b"\n"):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for i, t in order:
        at, removed, kept, units = 0, [], [], 0
        for unit in raw(t).split(separator):
            words = unit.lower().split()
            key = b" ".join(words)
            if len(words) >= lines.MIN_WORDS:
                units += 1
            if len(words) >= lines.MIN_WORDS and first.setdefault(key, (i, t, at)) != (i, t, at):
                removed.append((at, len(unit), first[key][0]))
            else:
                kept.append(unit)
            at += len(unit) + len(separator)
        out[i, t] = (units, len(removed), len(raw(t)), removed, hashlib.sha256(separator.join(kept)).hexdigest())
    return sorted(((i, *out[i, t]) for i, t in rows), key=repr)


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_line_dedup_equals_brute_force(spark, docs, unit):
    rows = [r for r in ROWS if r[0] != 44]  # equal ids with different texts rank by hash, see below
    rows = [(i, t or "") for i, t in rows] + [(60, "Some  Line of five\twords\n\nother line here with words"), (61, "x\nsome line OF five words\n\n\nend")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lines.remove_repeats(df, unit)
    have = sorted(((r.doc_id, r.n_units, r.n_removed, r.n_bytes, [tuple(x) for x in r.removed], r.kept_sha256) for r in out.collect()), key=repr)
    assert have == brute_lines(rows, lines.SEPARATORS[unit])
    assert lines.remove_repeats(empty(docs)).collect() == []
    assert lines.remove_repeats(docs).count() == len(ROWS)


def test_line_dedup_equals_its_sql(spark):
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duckdb.sql(lines.ORACLE)
    assert got(queries.op10_line_dedup(spark, SF), *want.columns) == sorted(want.fetchall(), key=repr)


def test_files_with_other_word_rules_are_refused():
    from loanscope.llm.chunks import ChunkWords
    with pytest.raises(ValueError, match="byte_bpe_50k"):
        ChunkWords(public_tokenizers.path("byte_bpe_50k.json"))


def test_language_results_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([("hello there", 5, "x")], "text string, score int, lang_pred string")
    out = langid.predict(df, None)
    assert out.columns == ["text", "lang_pred", "score"] and out.first().score == 0.0


def test_benchmark_slices_are_written_in_between(spark, monkeypatch):
    texts = [f"w{k}a w{k}b w{k}c w{k}d w{k}e w{k}f w{k}g w{k}h" for k in range(12)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    df = spark.createDataFrame([(k, f"start {t} end") for k, t in enumerate(texts)] + [(99, "clean words only")], "doc_id long, text string")
    want = sorted(map(str, tiling.contaminated(df, bench).collect()))
    monkeypatch.setattr(tiling, "SLICE_BYTES", 100)
    out = tiling.contaminated(df, bench)
    assert sorted(map(str, out.collect())) == want and out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sum(r.contaminated for r in out.collect()) == 12
