"""Language identification and quality rules."""

import re
from collections import Counter

import numpy as np

from tallygrove.llm import langid, quality
from tallygrove.llm.common import table


def test_gradients_are_those_of_the_loss():
    net, rng = langid.Network(["a", "b", "c"], hidden=5), np.random.default_rng(0)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(0, 256, (3, 7)).astype(np.uint8), np.array([0, 2, 1])
    loss = lambda: -np.log(net.probabilities(x)[:, np.arange(3), y]).mean()
    grads = net.gradients(x, y)
    for k, v in net.w.items():
        places = np.argwhere(np.abs(grads[k]) > 1e-5)
        for at in map(tuple, places[rng.permutation(len(places))[:4]]):
            old = v[at]
            v[at] = old + 1e-3
            up = loss()
            v[at] = old - 1e-3
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-3 - grads[k][at]) <= 0.03 * abs(grads[k][at]) + 1e-6


def test_reading_side_by_side_is_reading_alone():
    """Texts of many lengths at once, whole and in stretches, against one network run for each."""
    net, rng = langid.Network(["a", "b", "c"], hidden=5), np.random.default_rng(1)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 300, 7, 40, 41, 250, 3)]
    found = langid.pooled(net, texts, width=3)
    cut = langid.pooled(net, texts, width=4, stretch=32, lead=8)
    for k, t in enumerate(texts):
        alone = lambda x: net.probabilities(np.frombuffer(x, dtype=np.uint8)[None])[:, 0]
        assert np.allclose(found[k], alone(t).mean(axis=0) if t else 0, atol=1e-5)
        parts = [alone(t[max(0, s - 8) : s + 40])[min(s, 8) :][:32] for s in range(0, len(t), 32)]
        assert np.allclose(cut[k], np.concatenate(parts).mean(axis=0) if t else 0, atol=1e-5)


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    found = langid.identify(docs, per_language=200).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() >= 0.95
    assert found.score.between(0, 1).all()


def test_language_of_odd_rows(docs, empty):
    found = {r["doc_id"]: r for r in langid.identify(docs, per_language=5).collect()}
    assert len(found) == docs.count() and {found[i]["lang_pred"] for i in (0, 1, 2)} == {"und"} and found[7]["lang_pred"] == "en"
    assert langid.identify(empty).count() == 0


def test_base_counts(odd_texts):
    data = [(t or "").encode() for t in odd_texts]
    found = quality.base_counts(quality.Words(data))
    for i, t in enumerate(odd_texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert tuple(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_model_is_kneser_ney(spark):
    """Probabilities of seen n-grams against a direct computation, and that they sum to one over a context."""
    from tests.llm.conftest import documents

    texts = ["abab abc", "abca bab", "bcab aab"]
    path = quality.train(documents(spark, texts))
    grams = quality.grams([t.encode() for t in texts])
    counts = [Counter(grams.tolist())]
    for order in range(quality.ORDER - 1, 0, -1):
        counts.insert(0, Counter(g & ((1 << 8 * order) - 1) for g in counts[0]))
    p = {}
    for order, c in enumerate(counts, 1):
        n = Counter(c.values())
        share = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = []
        for i in (1, 2, 3):
            raw = i - (i + 1) * share * n[i + 1] / n[i] if share is not None and n[i] else i * 0.5
            d.append(min(float(i), max(0.0, raw)))
        for g, k in c.items():
            same = [x for h, x in c.items() if h >> 8 == g >> 8]
            weight = max(1e-9, sum(d[min(x, 3) - 1] for x in same) / sum(same))
            below = p[order - 1, g & ((1 << 8 * (order - 1)) - 1)] if order > 1 else 1 / 256
            p[order, g] = max(0.0, k - d[min(k, 3) - 1]) / sum(same) + weight * below
    own = np.unique(grams)
    found = quality.log_probabilities({"=en": own}, path)["=en"]
    assert np.allclose(found, [np.log2(p[quality.ORDER, g]) for g in own.tolist()])
    every = (own[0] >> 8 << 8) + np.arange(256)
    assert abs(np.exp2(quality.log_probabilities({"=en": every}, path)["=en"]).sum() - 1) < 0.2


def test_quality_of_odd_rows(docs, empty):
    found = {r["doc_id"]: r for r in quality.score(docs).collect()}
    assert len(found) == docs.count() and found[0]["base_failed"] and not found[0]["kept"] and found[0]["n_words"] == 0
    assert quality.score(empty).count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["kept"]}


def test_clean_prose_stays_and_junk_goes(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    labels = table(spark, sf.replace("0.001", "0.01"), "labels")
    rows = quality.score(docs).join(labels, "doc_id").toPandas()
    good, long = rows.quality == 1, rows.n_words >= 60
    assert rows[good & long].kept.mean() > 0.97 and rows[~good].kept.mean() < 0.6


def test_word_bits_are_of_the_other_documents(spark):
    from tests.llm.conftest import documents

    path = quality.train(documents(spark, ["red red blue", "blue\tgreen", "blue red", None, ""]))
    own = quality.Words([b"red blue green"]).digests
    order = np.argsort(own)
    assert np.allclose(quality.word_bits({"=en": own[order]}, path)["=en"], -np.log2(np.array([2, 3, 1]) - 0.5)[order])


def test_noise_on_words_is_outside_the_bands(spark, sf):
    """Noise in the words of labelled junk, which no base rule finds."""
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    labels = table(spark, sf.replace("0.001", "0.01"), "labels")
    rows = quality.score(docs).join(labels, "doc_id").toPandas()
    junk, clean = rows[(rows.quality == 0) & ~rows.base_failed], rows[(rows.quality == 1) & ~rows.base_failed]
    assert junk.kept.mean() < 0.3 and clean.kept.mean() > 0.98


def test_bands_need_no_exchange_by_language(spark, docs):
    plan = quality.judged(docs, ["doc_id", "text"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [__lang" in plan and "hashpartitioning(__lang" not in plan


def test_verdict_against_sorted_scores(spark, sf):
    """The bands of both scores from the sorted scores of each language, and who lies within them."""
    rows = quality.judged(table(spark, sf, "documents"), ["doc_id"]).toPandas()
    want = ~rows["__failed"]
    for bits in quality.BITS:
        for _, group in rows.groupby("__lang"):
            own = group[~group["__failed"] & group[bits].notna()]
            bins = np.sort(np.floor(own[bits].to_numpy() / 0.001)) * 0.001
            inside = np.zeros(len(group), dtype=bool)
            if len(bins):
                lo, mid, hi = (bins[max(0, int(np.ceil(q * len(bins) - 1e-9)) - 1)] for q in (0.25, 0.5, 0.75))
                low, high = mid - 7 * max(mid - lo, 0.01), mid + 7 * max(hi - mid, 0.01)
                inside = group[bits].between(low, high).to_numpy()
            want[group.index] &= inside
    assert (want == rows["__kept"]).all() and want.any() and not want.all()
