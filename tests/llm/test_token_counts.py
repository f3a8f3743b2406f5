import sentencepiece

from markhive.llm import token_counts
from markhive.llm.queries import model_path

from .conftest import ODD


def lengths(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    return [len(x) for x in library.encode([t or "" for t in texts])]


def check(df, texts):
    n = lengths(texts)
    table = token_counts.limits(token_counts.histogram(df, model_path())).cache()
    rows = table.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(n))
    for r in rows:
        at = r.n_tokens
        want = (n.count(at), sum(x > at for x in n), sum(x <= at for x in n) / len(n), sum(x for x in n if x <= at), sum(min(x, at) for x in n), sum(n))
        assert (r.n_docs, r.docs_over, r.docs_share, r.full_tokens, r.truncated_tokens, r.total_tokens) == want
    for limit in (0, 1, 3, 17, 100, 2048, max(n), 10**6):
        r = token_counts.at(table, limit).first()
        assert (r.docs_over, r.truncated_tokens, r.total_tokens) == (sum(x > limit for x in n), sum(min(x, limit) for x in n), sum(n))
    for share in (0.1, 0.5, 0.99, 1.0):
        assert token_counts.quantile(table, share).first()[0] == min(x for x in n if sum(y <= x for y in n) / len(n) >= share)


def test_odd_rows(odd, empty):
    check(odd, [t for _, t, *_ in ODD])
    assert token_counts.limits(token_counts.histogram(empty, model_path())).count() == 0


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, [r.text for r in docs.collect()])
