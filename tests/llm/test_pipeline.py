import corpus_pipeline
import public_tokenizers
import sentencepiece
from folioscope.llm import quality, secrets as s

from . import brute

DATA = "/root/testdata/sf0.001"


def redacted(text):
    spans = brute.secrets_base(text) + brute.secrets_entropy(text, s.WINDOW, s.CANDIDATE, s.CLASSES, s.ALLOWED)
    out, at = [], 0
    for i, _, j in sorted(spans):
        if out and i <= at:
            at = max(at, j)
            continue
        out.append(text[at:i])
        at = j
    return "[SECRET]".join([*out, text[at:]])


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()
    kept = [(r.doc_id, r.text) for r in scored if r.score >= 0.7]
    assert 0 < len(kept) < len(scored)
    first = {d for d, _, c in brute.jaccard(kept, 5, 80) if d == c}
    kept = [x for x in kept if x[0] in first]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute.decontaminate(kept, items) if r[-1]}
    want = {d: redacted(t) for d, t in kept if d not in bad}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert len(got) == len(want) and {r.doc_id: r.ids for r in got} == {d: [*library.encode(t), 2] for d, t in want.items()}
    assert all(r.n_tokens == len(r.ids) for r in got) and bad and any("[SECRET]" in t for t in want.values())


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            table = stage(spark, table, DATA)
            assert k == 4 or table.columns == docs.columns
        assert table.count() in (0, 3)
