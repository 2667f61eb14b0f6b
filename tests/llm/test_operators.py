"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import chat, components, embedding_dedup, language_id, line_dedup, lm_score, mixing, packing, quality, similar, simhash, token_counts
from pagewright.llm.queries import OP2_SQL, op2_chat_format, oracle_sql, queries, tokenizer_path

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def make(spark, texts, **extra):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


ODD = [None, "", " \n\t ", "a", "a\n\n", "word " * 3, "x y z w v " * 400, "ärger 'twas don't…　日本語 ﬁ é İ <|endoftext|> 12 $.", "a\rb\x0bc\x0cd\x85e\xa0f", "ends. Ends. $end. It's,"]


# --- tokens


def test_encoder_gives_the_ids_of_whole_texts(texts):
    from tokenizers import Tokenizer

    from pagewright.llm.tokens import WordEncoder

    t = Tokenizer.from_file(tokenizer_path())
    ours = WordEncoder(tokenizer_path())
    some = [x for x in [*ODD, *itertools.islice(texts.values(), 250)] if x]
    for x in some:
        assert ours(x).tolist() == t.encode(x, add_special_tokens=False).ids
    t.encode_special_tokens = True
    plain = WordEncoder(tokenizer_path(), special=False)
    plain.KEEP = 100  # the cache starts anew again and again
    for x in some[:60]:
        assert plain(x).tolist() == t.encode(x, add_special_tokens=False).ids


# --- components


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges * 2 + [(None, 3)], "a long, b long")
    for few in (components.FEW_LINKS, 0):
        rows = components.connected_components(df, few).collect()
        assert {r["node"]: r["root"] for r in rows} == {x: find(x) for x in parent} and len(rows) == len(parent)
        assert components.connected_components(df.limit(0), few).count() == 0


# --- ids


def test_long_ids_keep_their_digits_beside_nulls(spark):
    ids = [None, 9_007_199_254_740_993, -9_223_372_036_854_775_807, 5, None]
    df = spark.createDataFrame([(k, "some text of a few words here", "en", None, 1) for k in ids], DOCS)
    want = Counter(ids)
    for out in (
        packing.pack(df, tokenizer_path()),
        token_counts.count_tokens(df, tokenizer_path()),
        simhash.near_duplicates(df),
        lm_score.score(df),
        mixing.mix(df),
        language_id.identify(df, tokenizer_path("byte_bpe_multi_50k.tiktoken")),
        line_dedup.dedup_lines(df),
    ):
        assert out.schema["doc_id"].dataType.simpleString() == "bigint"
        assert Counter(r["doc_id"] for r in out.collect()) == want


# --- op1


def all_segmentations(model, word):
    total = np.zeros(len(model.langs))
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        p, start = np.ones(len(model.langs)), 0
        for end in [k + 1 for k, c in enumerate(cuts) if c] + [len(word)]:
            k = model.pieces.get(word[start:end])
            p = p * (model.p[k] if k is not None else 0)
            start = end
        total += p
    return np.log(total)


def test_forward_sums_all_segmentations():
    pieces = language_id.load_pieces(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    model = language_id.fit({"en": {"the": 5, "hen": 2}, "de": {"der": 4, "wörter": 1}}, pieces)
    assert np.allclose(model.p.sum(axis=0), 1)
    words = ["then", "wört", "x"]
    assert np.allclose(model.log_words(words), [all_segmentations(model, b" " + w.encode()) for w in words])
    both = [["then" * 9, "hender", "wörterthen" * 3], ["then" * 9, "wört" * 600, "x"]]
    for some in both:  # both kinds of lattice
        own = [b" " + w.encode() for w in some]
        short = [np.log(language_id.Lattice([w], pieces, len(model.p) - 1).forward(model.p)[-1])[0] for w in own if len(w) <= 40]
        long = language_id.LongLattice(own, pieces, model.starts).forward(model.p)
        assert np.allclose([x for x, w in zip(long, own, strict=True) if len(w) <= 40], short)
        assert np.isfinite(long).all()
    assert np.isfinite(model.log_words(["ab" * 5000])).all()


def test_expected_counts_of_long_words():
    pieces = language_id.load_pieces(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    model = language_id.fit({"en": {"the": 5, "hen": 2}}, pieces)
    words, weight = [b" thenhenthe", b" hethenthen", b" x"], np.array([2.0, 3.0, 1.0])
    got, want = np.zeros(len(model.p)), np.zeros(len(model.p))
    language_id.LongLattice(words, pieces, model.starts).expected(model.p, weight, got)
    for w, n in zip(words, weight, strict=True):
        language_id.Lattice([w], pieces, len(model.p) - 1).expected(model.p, np.array([n]), want)
    assert np.allclose(got, want)


def test_language_id_of_scripts_without_blanks(spark):
    """Made-up lexicons in Thai, Chinese and Japanese letters, two of them sharing a script, run together in long sentences."""
    rng = np.random.default_rng(2)
    scripts = {"th": [*range(0x0E01, 0x0E2F)], "zh": [*range(0x4E00, 0x4F00)], "zh2": [*range(0x4E00, 0x4F00)], "ja": [*range(0x3042, 0x3094), *range(0x4E00, 0x4E40)]}
    rows = []
    for lang, letters in scripts.items():
        lexicon = ["".join(map(chr, rng.choice(letters, rng.integers(1, 4)))) for _ in range(400)]
        p = 1 / np.arange(1, 401)
        for _ in range(150):
            rows.append((len(rows), "。".join("".join(rng.choice(lexicon, 25, p=p / p.sum())) for _ in range(3)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language_id.identify(df, tokenizer_path("byte_bpe_multi_50k.tiktoken")).collect()}
    for lang in scripts:
        held = [out[k] for k, _, x in rows if x == lang and out[k]["held_out"]]
        assert len(held) > 20 and np.mean([r["lang_pred"] == lang and r["score"] > 0.9 for r in held]) > 0.95


def test_language_id_on_held_out_rows(spark, docs):
    out = language_id.identify(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken")).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 1000
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_id_of_odd_rows(spark):
    vocabulary = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    rows = [(k, t, "en" if k % 2 else None) for k, t in enumerate(ODD)] + [(None, "the end", "en"), (3, "the end", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("_verdict_", F.lit(1))
    out = language_id.identify(df, vocabulary).collect()
    assert len(out) == len(rows)
    none = [r for r, t in zip(sorted(out, key=lambda r: -1 if r["doc_id"] is None else r["doc_id"]), [0], strict=False)]
    assert none[0]["doc_id"] is None and not none[0]["held_out"]
    by = {r["doc_id"]: r for r in out}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (0, 1, 2))
    assert language_id.identify(df.limit(0), vocabulary).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled, vocabulary).collect()} == {"und"}
    assert language_id.keep_known(df, vocabulary, 0.5).columns == df.columns


# --- op2


def test_chat_agrees_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    rel = con.sql(OP2_SQL)
    want = sorted(rel.fetchall())
    got = sorted(tuple(r) for r in op2_chat_format(spark, SF).select(*rel.columns).collect())
    assert got == want


def test_chat_prefix_and_masks(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (1, 3, "user", "more"), (1, 4, "assistant", "ok"),
        (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "bad"),
        (3, 0, "user", None), (3, 1, None, "x"), (4, 0, "user", None), (4, 1, None, "x"), (5, 0, "user", "alone"), (None, 0, "user", "z"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("side", F.lit(9))
    pairs = spark.createDataFrame([(0, 1, 2), (1, 3, 4), (2, 5, 6)], "pair_id long, chosen long, rejected long")
    out = {r["pair_id"]: r for r in chat.format_preferences(df, pairs).collect()}
    a = out[0]
    assert a["n_common"] == 2 and a["prompt"].count("<|system|>") == 1
    assert [a["chosen"][s.start : s.end] for s in a["chosen_spans"]] == ["good<|end|>\n", "ok<|end|>\n"]
    assert [a["rejected"][s.start : s.end] for s in a["rejected_spans"]] == ["bad<|end|>\n"]
    assert out[1]["n_common"] == 2 and out[1]["chosen"] == out[1]["rejected"] == ""
    assert out[2]["n_common"] == 0 and out[2]["rejected"] == "" and out[2]["chosen"] == "<|user|>\nalone<|end|>\n"
    assert chat.format_preferences(df.limit(0), pairs).count() == 0


# --- op3


def brute_lines(rows, divisor=line_dedup.DIVISOR):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    n_words = lambda x: len(WORD.findall(x))

    def split(text):
        lines, out = text.split("\n"), [[]]
        for k, line in enumerate(lines):
            out[-1].append(line)
            rolls = k and int(md5(md5(lines[k - 1]) + md5(line))[:2], 16) < 256 // divisor
            if k < len(lines) - 1 and (rolls or n_words(line) > 50 or n_words(lines[k + 1]) > 50):
                out.append([])
        return out

    places = defaultdict(set)
    for doc, text in rows:
        for i, chunk in enumerate(split(text) if text is not None else []):
            if sum(n_words(x) > 0 for x in chunk) >= 2 or any(n_words(x) > 50 for x in chunk):
                places["\n".join(chunk)].add((doc is None, doc or 0, signed(xxhash.xxh64_intdigest(text.encode(), 42)), i))
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None))
            continue
        key = signed(xxhash.xxh64_intdigest(text.encode(), 42))
        kept = [c for i, c in enumerate(split(text)) if not ((p := places.get("\n".join(c))) and min(p) != (doc is None, doc or 0, key, i))]
        out.append((doc, "\n".join(x for c in kept for x in c)))
    return Counter(out)


def test_line_dedup_agrees_with_brute_force(spark, texts):
    passage = "\n".join(f"line {k} of a passage that is long enough" for k in range(12))
    long = " ".join(f"w{k}" for k in range(60))  # one line
    own = [*texts.items()] + [(2000 + k, f"own {k}\n{'x' * k}\n{passage}\nend {k}") for k in range(30)]
    own += [(4000 + k, f"start {k}\n{long}\nend") for k in range(3)] + [(3000 + k, t) for k, t in enumerate(ODD)] + [(None, passage), (7, passage), (7, passage), (8, "\n\n\n\n" * 9), (9, passage + "\n" + passage)]
    df = spark.createDataFrame(own, "doc_id long, text string").withColumn("idx", F.lit(1)).withColumn("h", F.lit(2)).withColumn("lines", F.lit("z"))
    out = line_dedup.dedup_lines(df, counts=("a", "b"))
    assert out.columns == [*df.columns, "a", "b"]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == brute_lines(own)
    removed = out.where("doc_id between 2000 and 2029 and b > 0").count()
    assert removed >= 29  # a shifted passage is found again
    few = line_dedup.repeated_chunks(df, share=0, salts=3)  # the hot chunk of the passage is dealt out
    assert Counter(tuple(r) for r in few.collect()) == Counter(tuple(r) for r in line_dedup.repeated_chunks(df).collect())
    assert {r["text"] for r in out.where("doc_id in (4001, 4002)").collect()} == {"start 1\nend", "start 2\nend"}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def compare_with_sql(spark, sql, query, **tables):
    """Rows of a query and of its SQL on the same tables, written as Parquet."""
    import duckdb

    with tempfile.TemporaryDirectory() as folder:
        con = duckdb.connect()
        for name, df in tables.items():
            df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
        got, want = query(spark, folder), con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())


def test_chat_agrees_with_sql_on_nulls_and_ties(spark):
    rng, rows = random.Random(4), []
    for conv in range(60):
        for _ in range(rng.randint(1, 5)):
            rows.append((conv if rng.random() < 0.95 else None, rng.choice([None, 0, 1, 2]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "b"])))
    df = spark.createDataFrame(rows * 2, "conv_id long, turn long, role string, text string")
    compare_with_sql(spark, OP2_SQL, op2_chat_format, conversations=df)


@pytest.mark.parametrize("name", [n for n in oracle_sql() if n != "op2_chat_format"])
def test_query_agrees_with_sql(spark, name):
    tables = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "embeddings", "labels")}
    compare_with_sql(spark, oracle_sql()[name], queries()[name], **tables)


# --- op4


def test_packing_is_gapless_and_whole(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    some = [*itertools.islice(texts.items(), 400)] + [(5000 + k, x) for k, x in enumerate(ODD)] + [(None, "x y"), (1, texts[1]), (9000, "long words " * 9000)]
    df = spark.createDataFrame(some, "doc_id long, text string").withColumn("uid", F.lit(5)).withColumn("length", F.lit(1))
    out = packing.pack(df, tokenizer_path(), block=150, islands=3).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for doc, text in some:
        if doc == 1:
            continue
        want = [*(t.encode(text, add_special_tokens=False).ids if text else []), 0]
        got = b"".join(p[3] for p in sorted(pieces[doc]))
        assert np.frombuffer(got, "<u4").tolist() == want
        assert [p[2] for p in sorted(pieces[doc])][:-1] == [2048] * (len(want) // 2048 - (len(want) % 2048 == 0))
    bound = -(-sum(r["length"] for r in out) // 2048)
    assert len(seqs) <= 1.03 * bound + 3
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


def test_crossover_keeps_every_document_once():
    rng = random.Random(1)
    for size in (1, 2, 50, 700):
        sizes = [rng.randint(1, 2047) for _ in range(size)]
        bins, fill = packing.evolve(sizes, 2048, 5)
        assert sorted(i for b in bins for i in b) == list(range(size))
        assert fill == [sum(sizes[i] for i in b) for b in bins] and max(fill) <= 2048
        greedy, _ = packing.best_fit(sorted(range(size), key=lambda i: -sizes[i]), sizes, 2048, [], [])
        assert len(bins) <= len(greedy)


def test_evolution_beats_greedy_on_triplets():
    """Bins of three documents without room to spare: the optimum is known, and best fit alone is far from it."""
    for seed in range(3):
        rng, sizes = random.Random(seed), []
        for _ in range(200):
            a = rng.randint(380, 490)
            b = rng.randint((1000 - a) // 2 - 60, (1000 - a) // 2)
            sizes += [a, b, 1000 - a - b]
        rng.shuffle(sizes)
        greedy, _ = packing.best_fit(sorted(range(600), key=lambda i: -sizes[i]), sizes, 1000, [], [])
        bins, fill = packing.evolve(sizes, 1000, seed)
        assert sorted(i for b in bins for i in b) == [*range(600)]
        assert fill == [sum(sizes[i] for i in b) for b in bins] and max(fill) <= 1000
        assert 200 <= len(bins) <= 210 < 214 <= len(greedy)


def test_every_crossover_is_made_and_islands_start_apart(monkeypatch):
    calls, own = [], packing.cross
    monkeypatch.setattr(packing, "cross", lambda *a: calls.append(1) or own(*a))
    rng = random.Random(1)
    sizes = [rng.randint(1, 2047) for _ in range(500)]
    packing.evolve(sizes, 2048, 1)
    assert len(calls) == packing.CROSSOVERS
    begun = [[s[0] for s in packing.starts(sizes, 2048, island, random.Random(1), 4)] for island in (0, 1)]
    assert not any(a == b for a in begun[0] for b in begun[1])


# --- op5


def brute_vectors(rows, cosine=embedding_dedup.COSINE):
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in good}
    for a, b in itertools.combinations(good, 2):
        if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
            n[a] += 1
            n[b] += 1
            parent[find(a)] = find(b)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted((r[0], n[k], least[find(k)], r[0] == least[find(k)]) for k, r in enumerate(rows))


def test_embeddings_agree_with_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    rows = []
    for k in range(900):
        v = base[k % 150] + rng.normal(size=16) * (0.02 if k % 3 else 0.12)
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 2)))
    rows += [(1000 + k, rows[5][1], 1) for k in range(40)]  # copies of one vector
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, rows[5][1], None), (2004, [], 1), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [None] + [1.0] * 15, 1), (2008, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1)).withColumn("point", F.lit(2))
    want = brute_vectors(rows)
    for hot in (embedding_dedup.HOT, 100):
        out = embedding_dedup.near_duplicates(df, leaf=16, hot=hot)
        assert sorted(tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").collect()) == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_below_the_limit_do_not_link(spark):
    p = next(p for p in range(1 << 24, 0, -1) if 0 < 0.98 - p / (p * p + int(np.ceil(p * np.tan(np.arccos(0.98)))) ** 2) ** 0.5 < 9e-10)
    q = int(np.ceil(p * np.tan(np.arccos(0.98))))
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [float(p), float(q)], 0), (3, [float(p), float(q - 1)], 0)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df.where("vec_id < 3")).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 1)}


def test_embeddings_recall_of_deep_trees(spark):
    """A large label beside small ones, at default parameters: depth 4, spill and many leaves."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(8_000, 64))
    near = np.repeat(base[:6_000], 2, axis=0)
    near = near + rng.normal(size=near.shape) * 0.19 * rng.random((len(near), 1))  # about the limit, on both sides
    x = np.concatenate([base, near]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    label = np.where(np.arange(len(x)) % 50 == 7, 1 + np.arange(len(x)) % 3, 0)
    n = np.concatenate([((unit[k : k + 1000] @ unit.T >= 0.98) & (label[k : k + 1000, None] == label)).sum(axis=1) - 1 for k in range(0, len(x), 1000)])
    df = spark.createDataFrame([(k, v, int(c)) for k, (v, c) in enumerate(zip(x.tolist(), label, strict=True))], "vec_id long, embedding array<float>, label int").repartition(4)
    for options in ({}, {"hot": 1_000}):
        got = np.zeros(len(x), int)
        for r in embedding_dedup.near_duplicates(df, **options).select("vec_id", "n_links").collect():
            got[r["vec_id"]] = r["n_links"]
        assert (got <= n).all() and n.sum() > 10_000
        assert got.sum() >= 0.99 * n.sum(), got.sum() / n.sum()


# --- op6


def brute_base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("text", F.lit(1))
    own = [*texts.items()] + [(9000 + k, t) for k, t in enumerate([*ODD, "a b c d e " * 3 + "z", "q " * 4, "é #1 | é\n\né #1 | é", " lead\tand trail \n"])] + [(None, "x y z")]
    df = spark.createDataFrame(own, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("quality", F.lit(1))
    out = quality.judge(df, labels).collect()
    assert len(out) == len(own)
    by = {r["doc_id"]: r for r in out}
    for doc, text in own:
        r = by[doc]
        n, chars, symbols, lines, repeat = brute_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeat), text
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (r["base_failed"] and r["kept"])
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    kept = lambda ids: np.mean([by[k]["kept"] for k in ids if k in by and not by[k]["base_failed"]] or [0])
    assert kept(good) > 0.97
    assert kept(bad) < kept(good)
    assert quality.judge(df.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.judge(df.limit(50), labels.limit(0)).collect()} == {0.0}


def le(x):
    return (x % (1 << 64)).to_bytes(8, "little")


def test_log_ratio_agrees_with_brute_force(spark, docs, texts):
    ids = sorted(texts)[:40]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    raw, good = np.ones(64), np.ones(64)
    for k, text in texts.items():
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text)]
        g = [signed(x) % 64 for x in h] + [signed(xxhash.xxh64_intdigest(le(b), xxhash.xxh64_intdigest(le(a), 42))) % 64 for a, b in zip(h, h[1:], strict=False)]
        for b in g:
            raw[b] += 1
            good[b] += k in ids
    trusted = spark.createDataFrame([(k,) for k in ids], "_id long")
    assert np.allclose(quality.log_ratio(docs, trusted, 64), np.log(good / good.sum()) - np.log(raw / raw.sum()))


def test_threshold_is_over_all_trusted_documents(spark, docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    scores, kept = zip(*[(r["score"], r["kept"] or r["base_failed"]) for r in quality.judge(docs, labels, trusted=20, quantile=0.1, margin=0.0).collect()], strict=True)
    low = np.quantile(scores, 0.1)
    assert all(k for s, k in zip(scores, kept, strict=True) if s > low + 1e-12)
    by_score = [s for s, k in zip(scores, kept, strict=True) if not k]
    assert by_score and max(by_score) < low


# --- op7


def test_scan_stitches_blocks(spark, tmp_path):
    rng = random.Random(2)
    want = []
    for name in "abc":
        ids, ordinal = [], 0
        for _ in range(60):
            n = rng.choice([0, 0, 1, 3, 40])
            want.append((f"file:{tmp_path}/{name}.bin", ordinal, len(ids), n, True))
            ids += [rng.randrange(9) for _ in range(n)] + [9]
            ordinal += 1
        if name == "b":
            want.append((f"file:{tmp_path}/{name}.bin", ordinal, len(ids), 5, False))
            ids += [1] * 5
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    for block_ids, span, whole in ((7, 3, 1 << 20), (1, 2, 0), (10_000, 4, 900), (7, 3, 900)):
        blocks = token_counts.read_flat(spark, f"{tmp_path}/*.bin", block_ids=block_ids, whole=whole)  # some whole, some by ranges
        got = token_counts.scan(blocks, close=9, span=span).collect()
        assert sorted((r["file"], r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in got) == sorted(want)


def test_token_counts_of_documents(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    some = [*itertools.islice(texts.items(), 300)] + [(5000 + k, x) for k, x in enumerate(ODD)] + [(None, "x y")]
    df = spark.createDataFrame(some, "doc_id long, text string").withColumn("file", F.lit(1)).withColumn("block", F.lit(None))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, tokenizer_path()).collect()}
    assert got == {k: len(t.encode(x, add_special_tokens=False).ids) if x else 0 for k, x in some}
    assert token_counts.count_tokens(df.limit(0), tokenizer_path()).count() == 0


# --- op8


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(fps):
    keys = list(dict.fromkeys(fps.values()))
    arr = np.array(keys, np.uint64)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in np.flatnonzero(np.bitwise_count(arr[a] ^ arr) <= 4).tolist():
            parent[find(max(find(a), find(b)))] = min(find(a), find(b))
    least, at = {}, {k: i for i, k in enumerate(keys)}
    for doc, fp in fps.items():
        r = find(at[fp])
        least[r] = min(least.get(r, doc), doc)
    return {doc: least[find(at[fp])] for doc, fp in fps.items()}


def test_simhash_agrees_with_brute_force(spark, texts):
    own = dict(texts) | {9000 + k: t for k, t in enumerate(ODD)}
    rng = random.Random(5)
    words = texts[0].split()
    for k in range(300):  # one large group of near copies
        w = list(words)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(9999)}"
        own[20_000 + k] = " ".join(w)
    df = spark.createDataFrame([*own.items()], "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("root", F.lit(1))
    fps = {k: brute_fingerprint(t) for k, t in own.items()}
    want = {k: (f"{fps[k]:016x}", c) for k, c in brute_classes(fps).items()}
    for hot in (simhash.HOT, 50):
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, hot=hot).collect()}
        assert got == want
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, (_, c) in want.items() if c == k)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c d e f g"), (1, "c d e f g"), (1, "q r s t u v")], "doc_id long, text string")
    assert simhash.near_duplicates(odd).count() == 5
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_first(odd).collect()) == [(0, "a b"), (1, "c d e f g"), (1, "q r s t u v")]


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a.copy()
    for _ in range(6):
        flip = np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)
        b = np.where(rng.random(4000) < 0.7, b ^ flip, b)
    count = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * s)) & np.uint64(3)) for s in range(32)]).astype(int)
    d = simhash.manhattan(simhash._points(a.view(np.int64)), simhash._points(b.view(np.int64)))
    assert (d == np.abs(count(a) - count(b)).sum(axis=0)).all()
    assert (d <= np.bitwise_count(a ^ b)).all()


def test_large_runs_keep_all_components():
    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 62), 1 << 62, 3)
    fp = np.unique(np.concatenate([base, *[b ^ (np.int64(1) << rng.integers(0, 63, 300)) ^ (np.int64(1) << rng.integers(0, 63, 300)) for b in base]]))
    a, b = simhash.cell_links([np.zeros(len(fp), np.int64)], fp, 4)
    got = dict(zip(a.tolist(), b.tolist(), strict=True))
    want = brute_classes({int(x): int(np.uint64(x.view(np.uint64))) for x in fp})
    assert {int(x): got.get(int(x), int(x)) for x in fp} == want


def brute_similar(texts, shingle=5, least=0.8):
    """doc_id to the least id reachable by links of that Jaccard similarity."""
    sets = {}
    for doc, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words[k : k + shingle]) for k in range(max(len(words) - shingle + 1, 1))} if words else set()
    root = {doc: doc for doc in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y)):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {doc: find(doc) for doc in texts}


def near_copies(n, seed):
    """Texts of random words; copies with some words changed, over all similarities; a chain of edits; a hot group."""
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    out = []
    for _ in range(n):
        base = word(int(rng.integers(6, 400)))
        out.append(base)
        for share in (0.0, 0.01, 0.02, 0.05):
            out.append([w if rng.random() >= share else f"x{rng.integers(1 << 30)}" for w in base])
    chain = word(200)
    for k in range(8):
        chain = [*chain[:k * 20], f"y{k}", *chain[k * 20 + 1:]]
        out.append(chain)
    hot = word(150)
    out += [[*hot[:k], f"z{k}", *hot[k + 1:]] for k in range(120)]
    return {k: " ".join(t) for k, t in enumerate(out)}


def test_keep_similar_agrees_with_brute_force(spark):
    texts = near_copies(60, 3) | {-1: "", -2: None, -3: "one two", -4: "One  two"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").withColumn("f0", F.lit(1)).withColumn("node", F.lit("x"))
    want = sorted({*brute_similar(texts).values()})
    for options in ({}, {"hot": 10, "few": 3, "hubs": 1, "load": 2_000}):
        kept = similar.keep_similar(df, **options)
        assert kept.columns == df.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert similar.keep_similar(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c d e f g"), (1, "c d e f g"), (1, "q r s t u v")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in similar.keep_similar(odd).collect()) == [(0, "a b"), (1, "c d e f g"), (1, "q r s t u v")]


def edits(n, seed):
    """One original, and edits of it that are similar to it but seldom to each other."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(204)]  # 200 shingles
    out = [base]
    for k in range(n):
        text = list(base)
        for at in rng.choice(40, 4, replace=False):  # each change alters five shingles: 180 of 220 stay
            text[2 + 5 * int(at)] = f"x{k}.{at}"
        out.append(text)
    return {k: " ".join(t) for k, t in enumerate(out)}


def test_keep_similar_tries_every_candidate_of_a_group_of_edits(spark):
    texts = edits(400, 7)
    assert {*brute_similar(texts).values()} == {0}
    for order in (1, -1):  # the original has the least id or the greatest
        df = spark.createDataFrame([(order * k, t) for k, t in texts.items()], "doc_id long, text string")
        assert similar.keep_similar(df).count() == 1


def test_keep_similar_finds_pairs_of_short_texts(spark):
    text = lambda k, m: " ".join(f"a{k}.{j}" for j in range(m))
    texts = {k: text(k // 2, 8 + k % 2) for k in range(600)}  # 4 and 5 shingles
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.keep_similar(df).collect()) == sorted({*brute_similar(texts).values()}) == [2 * k for k in range(300)]


def test_network_learns_and_prefers_sense(spark, docs):
    out = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    assert len(out) == 1000
    vocab = lm_score.vocabulary(docs)
    assert len(vocab) == lm_score.FREQUENT
    coded = lm_score.written(lm_score.code(docs, vocab))
    counts, cells = lm_score.counts_of(coded)
    net = lm_score.train(*lm_score.blocks_of(coded, int(counts.sum())), counts)
    coder = lambda text: lm_score.split(lm_score.Coder(vocab)(text))[0]
    rng = np.random.default_rng(0)
    better = []
    for r in docs.orderBy("doc_id").limit(200).collect():
        ids = coder(r["text"])
        if len(ids) > 50:
            mixed = rng.permutation(ids)
            better.append(net.log_prob(net.contexts(ids), ids).mean() > net.log_prob(net.contexts(mixed), mixed).mean())
    assert np.mean(better) > 0.75
    start = lm_score.Net()
    ids = coder(docs.first()["text"])
    assert net.log_prob(net.contexts(ids), ids).mean() > start.log_prob(start.contexts(ids), ids).mean() + 0.3
    # counts, and one text's score, by plain loops
    words = Counter(w for r in docs.collect() for w in (r["text"] or "").lower().split())
    assert int(counts.sum()) == sum(words.values()) and all(counts[k] == words[w] for w, k in vocab.items())
    place = lambda w: divmod(zlib.crc32(w.encode()) % (lm_score.SHARED * lm_score.MEMBERS), lm_score.SHARED)[::-1]
    rest = Counter()
    for w, n in words.items():
        if w not in vocab:
            rest[place(w)] += n
    r = docs.orderBy("doc_id").first()
    own, want = (r["text"] or "").lower().split(), 0.0
    ids = [vocab.get(w, lm_score.FREQUENT + place(w)[0]) for w in own]
    pad, side = lm_score.CLASSES**2, lm_score.SIDE
    for k, w in enumerate(own):
        window = [ids[j] if 0 <= j < len(own) else pad for j in range(k - side, k + side + 1) if j != k]
        h = np.tanh(sum(net.w[0][j * (pad + 1) + t] for j, t in enumerate(window)) + net.w[1])
        c, m = divmod(ids[k], lm_score.CLASSES)
        for weights, at in ((net.w[2], c), (net.w[3][c], m)):
            z = h @ weights[:-1] + weights[-1]
            want += z[at] - np.log(np.exp(z).sum())
        if w not in vocab:
            token, cell = place(w)
            all_ = sum(n for (t, _), n in rest.items() if t == token)
            want += np.log((rest[token, cell] + lm_score.ALPHA) / (all_ + lm_score.ALPHA * lm_score.MEMBERS))
    assert abs(out[r["doc_id"]]["log_prob"] - want) < 1e-3 * abs(want) and out[r["doc_id"]]["n_tokens"] == len(own)


def test_lm_score_does_not_depend_on_partitions(spark, docs):
    some = docs.where("doc_id < 200").select("doc_id", "text")
    some = some.unionAll(some.where("doc_id < 20"))  # copies weigh twice
    got = [{r["doc_id"]: r["score"] for r in lm_score.score(df, per_block=20_000).collect()} for df in (some.coalesce(1), some.repartition(4))]
    assert max(abs((a or 0) - (got[1][k] or 0)) for k, a in got[0].items()) < 1e-5


def test_weights_of_a_batch_are_copies_of_its_rows():
    rng = np.random.default_rng(3)
    c, t, n = rng.integers(0, 17, (6, 4)).astype(np.int32), rng.integers(0, 16, 6), np.array([1, 3, 1, 2, 1, 1])
    nets = [lm_score.Net(tokens=16, width=5) for _ in range(2)]
    nets[0].step(c, t, 0.1, n.astype(float))
    nets[1].step(np.repeat(c, n, axis=0), np.repeat(t, n), 0.1)
    assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(nets[0].w, nets[1].w, strict=True))


def test_log_probs_sum_to_one_and_gradient():
    net = lm_score.Net(tokens=16, width=5)
    rng = np.random.default_rng(3)
    for x in net.w:
        x += rng.normal(0, 0.3, x.shape).astype(np.float32)
    c = rng.integers(0, 17, (1, 4)).repeat(16, 0).astype(np.int32)
    assert np.isclose(np.exp(net.log_prob(c, np.arange(16))).sum(), 1, atol=1e-5)
    c, t = rng.integers(0, 17, (40, 4)).astype(np.int32), rng.integers(0, 16, 40)
    before = net.log_prob(c, t).mean()
    for _ in range(20):
        net.step(c, t, 0.02)
    assert net.log_prob(c, t).mean() > before


def test_lm_score_of_odd_rows(spark):
    df = make(spark, ODD * 2).withColumn("score", F.lit(1)).withColumn("word", F.lit(1))
    out = lm_score.score(df).collect()
    assert len(out) == 2 * len(ODD)
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"] % len(ODD)].append(r["score"])
        assert (r["score"] is None) == (r["n_tokens"] == 0)
    assert all(a == b or abs(a - b) < 1e-5 for a, b in by.values())
    assert by[0] == [None, None]
    assert lm_score.score(df.limit(0)).count() == 0


# --- op10


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(most * sizes[s] for s in capped)) / max(1e-9, sum(w[s] for s in names if s not in capped))
        more = {s for s in names if s not in capped and w[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= more


@pytest.mark.parametrize("bucket", [50_000, 20])
def test_mixing_meets_targets(spark, docs, bucket):
    odd = spark.createDataFrame([(9000 + k, t, "en", s, 0) for k, t in enumerate(ODD) for s in (None, "zz")] + [(None, "a b", "en", None, 0)] * 2, DOCS)
    df = docs.unionByName(odd).withColumn("size", F.lit(77)).withColumn("rate", F.lit("x")).withColumn("copies", F.lit("x"))
    out = mixing.mix(df, bucket=bucket).collect()
    assert len(out) == df.count()
    own = {(r["doc_id"], r["source"]): r["text"] for r in df.collect()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in out:
        assert r["size"] == len(WORD.findall(own[r["doc_id"], r["source"]] or "")) and 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    want = brute_targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and np.isclose(r["target"], want[r["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s]
    again = mixing.mix(df.repartition(3), bucket=bucket).collect()
    assert Counter(out) == Counter(again)
    rows = mixing.mixed_rows(df, bucket=bucket)
    assert rows.columns == df.columns
    taken_of = Counter()
    for r in out:
        taken_of[r["doc_id"], r["source"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"]) for r in rows.collect()) == +taken_of
    assert mixing.mix(df.limit(0)).count() == 0


def test_pivot_keeps_expectations():
    a = np.array([5.0, 3.0, 2.0, 7.0])
    mean = np.zeros(4)
    for k in range(4000):
        x = np.array([0.3, 0.5, 0.25, 0.6])
        rng = np.random.default_rng(k)
        left = mixing._pivot(x, a, rng)
        assert np.isclose(x @ a, 0.3 * 5 + 1.5 + 0.5 + 4.2)
        if left is not None:
            x[left] = rng.random() < x[left]
        assert set(x) <= {0.0, 1.0}
        mean += x / 4000
    assert np.allclose(mean, [0.3, 0.5, 0.25, 0.6], atol=0.03)


# --- names


def test_stages_keep_columns_of_any_name(spark, docs):
    from pagewright.llm import common

    names = ["_key", "_lines", "_ends", "_gone", "_id", "_k", "_chunks", "_removed", "_n", "_copy", "_m", "_copies", "_doc_id", "_own", "_th", "_d", "_t", "_verdict", "_pwn", "_PWH", "_pw_h", "h", "d", "t", "s", "k", "p", "node", "part", "task", "v", "idx", "size", "copies", "a.b"]
    own = docs.where("doc_id < 60")
    df = own.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    vocabulary = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    for stage in (lambda x: language_id.keep_known(x, vocabulary, 0.5), line_dedup.dedup_lines, simhash.keep_first, similar.keep_similar, mixing.mixed_rows):
        out, plain = stage(df), stage(own)
        assert out.columns == df.columns
        got = out.collect()
        assert all(list(r)[len(own.columns):] == [*range(len(names))] for r in got)
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in plain.collect())
    assert not any(c.lower().startswith(common.prefix_for(df)) for c in df.columns)
