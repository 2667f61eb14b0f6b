"""The corpus pipeline: each stage against brute force on what it was given, and the whole run."""

import re
from collections import Counter, defaultdict

import pytest
from test_operators import ODD, brute_classes, brute_fingerprint, brute_lines, brute_similar, brute_targets, near_copies

import corpus_pipeline
from pagewright.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and made."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.written(stage(spark, docs, SF))
        out[name] = docs, made
        docs = made
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_order_and_columns(stages):
    assert [*stages] == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "best-fit packing"]
    for name, (given, made) in [*stages.items()][:-1]:
        assert made.columns == given.columns, name


def test_language_stage_keeps_clean_rows(stages):
    given, made = stages["language ID"]
    assert made.count() >= 0.99 * given.count()
    assert not Counter(rows(made)) - Counter(rows(given))


def test_line_stage(stages):
    given, made = stages["line dedup"]
    assert Counter(rows(made)) == brute_lines(rows(given))


def test_simhash_stage(stages):
    given, made = stages["SimHash near-dedup"]
    assert sorted(r["doc_id"] for r in made.collect()) == sorted({*brute_similar(dict(rows(given))).values()})


def test_simhash_stage_holds_all_links_of_fingerprints(spark):
    """Texts that repeat themselves: within 4 bits of each other, but unlike as sets of shingles."""
    texts = near_copies(20, 9)
    for k in range(40):
        body = " ".join(f"b{k // 4}.{j}" for j in range(9))
        texts[10_000 + k] = f"{f'{body} ' * 60}{' '.join(f't{k}.{j}' for j in range(12))}"
    fps = {k: brute_fingerprint(t) for k, t in texts.items()}
    by_bits, by_sets = brute_classes(fps), brute_similar(texts)
    assert [by_sets[10_000 + k] for k in range(40)] == [10_000 + k for k in range(40)]
    want, before = {k: k for k in texts}, None
    while want != before:  # classes of both kinds, joined
        before = want
        for classes in (by_bits, by_sets):
            least = {}
            for k, c in classes.items():
                least[c] = min(least.get(c, want[k]), want[k])
            want = {k: least[c] for k, c in classes.items()}
    assert len({*want.values()}) < len({*by_sets.values()}) - 20
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    kept = corpus_pipeline.simhash_stage(spark, df, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({*want.values()})


def test_mixing_stage(stages):
    given, made = stages["mixing"]
    size = lambda t: len(WORD.findall(t or ""))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in given.collect():
        sizes[r["source"]] += size(r["text"])
        largest[r["source"]] = max(largest[r["source"]], size(r["text"]))
    for r in made.collect():
        taken[r["source"]] += size(r["text"])
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= largest[s]
    assert max(Counter(r["doc_id"] for r in made.collect()).values()) <= 3


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    given, made = stages["best-fit packing"]
    t = Tokenizer.from_file(tokenizer_path())
    want = Counter((doc, len(t.encode(text, add_special_tokens=False).ids) + 1 if text else 1) for doc, text in rows(given))
    pieces, seqs = Counter(), defaultdict(list)
    for r in made.collect():
        pieces[r["doc_id"]] += r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    total = Counter()
    for (doc, n), k in want.items():
        total[doc] += n * k
    assert pieces == total
    for spans in seqs.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048


def test_odd_rows_run_through_all_stages(spark):
    own = [(k, t, "en" if k % 2 else None, None if k % 3 else "s", 0) for k, t in enumerate(ODD * 2)] + [(None, "x y z", None, None, None)] * 2
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.written(stage(spark, df, SF))
        assert df.count() >= 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 900 and {"doc_id", "sequence_id", "offset"} <= {*out.columns}


@pytest.mark.parametrize("stage", ["SimHash near-dedup", "mixing"])
def test_workers_let_go_of_what_earlier_stages_held(spark, stage):
    def holding(batches):
        from pagewright.llm import tokens

        for pdf in batches:
            tokens.held("an earlier stage's", lambda: bytearray(1 << 20))
            yield pdf

    def probe(batches):
        from pagewright.llm import tokens

        for pdf in batches:
            yield pdf.__class__({"key": [str(tokens._held[0])]})

    docs = spark.createDataFrame([(k, f"word{k} " * 9 + "some more words", "en", "ab"[k % 2], 40) for k in range(200)], "doc_id long, text string, lang string, source string, n_chars long").repartition(16)
    spark.range(0, 64, 1, 64).mapInPandas(holding, "id long").count()
    dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).count()
    left = [r["key"] for r in spark.range(0, 64, 1, 64).mapInPandas(probe, "key string").collect()]
    assert left == ["None"] * 64
