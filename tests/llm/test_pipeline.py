import random

import public_tokenizers
import pytest

import corpus_pipeline
from corpuswarden.llm import decontaminate, quality, secrets, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    item = prose(30)
    texts, labels = [], []
    for k in range(300):
        text, good = prose(rng.randint(30, 90)), 1
        if k % 6 == 0:
            text, good = " ".join([rng.choice(vocabulary) + "%%%"] * 60), 0
        texts.append(text)
        labels.append((k, good, 0))
    clean = set(k for k in range(300) if k % 6)
    texts += [texts[1], texts[1].upper(), f"{prose(20)} {item}", f'{prose(40)} token = "abcdefgh12345678"', None, ""]
    texts[7] = texts[7].replace(" ", "  ", 1)
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, clean


def test_stages_are_the_agreed_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "decontamination", "secrets", "encoding"]


def test_each_stage_decides_and_keeps_columns(spark, tables):
    folder, texts, clean = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == out.count()
        kept[name] = rows
        docs = spark.createDataFrame(list(rows.values()), out.schema)
    assert clean <= kept["quality"].keys()
    assert not any(k % 6 == 0 for k in kept["quality"] if k < 300)
    assert 300 not in kept["near_duplicates"] and 301 not in kept["near_duplicates"] and clean <= kept["near_duplicates"].keys()
    assert 302 not in kept["decontamination"] and clean <= kept["decontamination"].keys()
    assert kept["secrets"].keys() == kept["decontamination"].keys()
    assert kept["secrets"][303].text == texts[303].replace("abcdefgh12345678", secrets.MASK)
    assert all(r.n_chars == len(r.text or "") for r in kept["secrets"].values())
    assert all(kept["secrets"][k].text == texts[k] for k in clean)


def test_run_equals_the_operators_by_hand(spark, tables):
    folder, texts, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r.doc_id for r in quality.report(docs, labels).collect() if r.predicted}
    left = docs.where(docs["doc_id"].isin(sorted(good)))
    first = {r.component for r in simhash.groups(left).collect()}
    hit = {r.id for r in decontaminate.scan(left, benchmark).collect() if r.n_hit}
    want = first - hit
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert rows.keys() == want
    import tiktoken
    from corpuswarden.llm.prefix_bpe import load_ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=load_ranks(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    for k in want - {303}:
        assert rows[k].ids == library.encode_ordinary(texts[k] or "")
        assert rows[k].n_tokens == len(rows[k].ids)


def test_odd_rows_and_clashing_columns(spark, tables):
    folder, texts, _ = tables
    long = " ".join(f"w{k % 1013}" for k in range(60_000))
    rows = [(1, texts[1]), (1, texts[1]), (None, texts[2]), (None, None), (2, None), (2, ""), (3, long), (3, long),
            (4, f"{texts[4]} secret: abcdefgh12345678")]
    docs = spark.createDataFrame([(k, t, None, None, None if t is None else len(t)) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "'x' as id", "1 as digest", "2 as row", "'y' as words", "3 as score", "'n' as new", "4 as spans")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = sorted(((r.doc_id, r.n_chars == len(r.text or "") if r.n_chars is not None else None)
                   for r in docs.collect()), key=str)
    assert len({k for k, _ in left}) == len(left)  # one of each repeated row, one of the empty ones
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(left)


def test_empty_documents(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
