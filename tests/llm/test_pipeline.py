"""The pipeline on small tables, and the registry."""

import random

import corpus_pipeline
from tallygrove.llm import registry
from tallygrove.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    from tallygrove.llm.common import cut

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf), "stage")
        assert docs.columns == columns, name
        after = docs.count()
        assert 0 < after <= before
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(registry.oracle_sql()) <= set(names)


OWN = ["__h", "__removed", "__kept", "__lang", "__H1", "__text"]


def stage_input(spark, texts, ids):
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c} of {k}" for c in OWN]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __h string, __removed string, __kept string, __lang string, __H1 string, __text string")


def test_stages_keep_columns_of_any_name(spark, sf, odd_texts):
    """Null ids and texts, repeated ids, columns named like the operators' own: every row that stays is one of the input but for text and n_chars."""
    from tallygrove.llm.common import cut

    real = [r["text"] for r in table(spark, sf, "documents").limit(40).collect()]
    texts = [*odd_texts, *real, real[0]]
    docs = stage_input(spark, texts, [None, None, 7, 7, *range(10, 6 + len(texts))])
    known = {tuple(r[c] for c in ("doc_id", "lang", "source", *OWN)) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, sf), "stage")
        rows = out.collect()
        assert out.columns == docs.columns and rows, name
        assert {tuple(r[c] for c in ("doc_id", "lang", "source", *OWN)) for r in rows} <= known, name
        assert len({r["__h"] for r in rows}) == len(rows)
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_stages_of_an_empty_table(spark, sf):
    docs = stage_input(spark, [], [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_passages_of_over_fifty_words_go(spark, sf):
    """Passages of 51 words that two texts share, of common words (under 400 bytes) and of single letters, are cut whole; what stands around them and shorter ones stay."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("aeiourstln") for _ in range(rnd.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    letters = lambda n: " ".join(rnd.choice("abcdeé,") for _ in range(n))
    passages, short = [prose(51), letters(51), " ".join([prose(25), letters(26)])], prose(48)
    around = [(f"{prose(30)} {edge}", f"{edge} {prose(30)}") for edge in "ABCDEFGH"]
    texts = [f"{a} {passages[k // 2] if k < 6 else short} {b}" for k, (a, b) in enumerate(around)]
    assert max(len(p.encode()) for p in passages) < 400 and len(short) > 254
    rows = corpus_pipeline.repeat_dedup(spark, stage_input(spark, texts, range(8)), sf).collect()
    found = {r["doc_id"]: r["text"] for r in rows}
    assert [found[k] for k in range(6)] == ["".join(pair) for pair in around[:6]]  # the spaces around a passage repeat too
    assert [found[k] for k in (6, 7)] == texts[6:]
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def broadcast_rows(spark, since):
    """Rows of the broadcasts of executions from number since on."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    every = lambda seq: [seq.apply(i) for i in range(seq.size())]
    for number in [e.executionId() for e in every(store.executionsList()) if e.executionId() >= since]:
        counts = store.executionMetrics(number)
        ids = [m.accumulatorId() for node in every(store.planGraph(number).allNodes()) if node.name().startswith("BroadcastExchange") for m in every(node.metrics()) if m.name() == "number of output rows"]
        out += [int(counts.apply(i).replace(",", "")) for i in ids if counts.contains(i)]
    return out


def test_near_dedup_broadcasts_no_more_rows_than_documents(spark, sf):
    """The cells that a fingerprint is exploded to, a hundred of each, were broadcast whole."""
    docs, since = table(spark, sf, "documents"), spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert corpus_pipeline.near_dedup(spark, docs, sf).count() > 0
    found = broadcast_rows(spark, since)
    assert found and max(found) <= docs.count()
