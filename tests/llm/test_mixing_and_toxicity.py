import math
import random
from pathlib import Path

import numpy as np
import pytest

from corpuskit.llm import mixing, toxicity

needs_vocabulary = pytest.mark.skipif(not Path(mixing.TOKENIZER).exists(), reason="no vocabulary")
DOCS = "doc_id bigint, source string, text string, tokens string, copies int, cdf int"
TARGETS = "mixture string, total_tokens bigint, source string, target_share double, max_repeats int, rate string"


@pytest.mark.parametrize("cap", [1, 2, 5, 40, 2000, 10**9])
def test_capped_poisson_keeps_its_mean(cap):
    mean = lambda first, cdf: first + sum(1 - p for p in cdf)
    for rate in (0.0, 0.01, 900, 1_500, *((0.5 * cap, 0.95 * cap, cap, 3 * cap) if cap <= 2000 else ())):
        first, cdf = mixing.capped_cdf(rate, cap)
        assert first + len(cdf) <= max(cap, 1) and mean(first, cdf) == pytest.approx(min(rate, cap), abs=1e-6 * max(1, rate))
        assert cdf == sorted(cdf)
    assert mixing.capped_cdf(1.0, 0) == (0, [1.0])
    first, cdf = mixing.poisson_cdf(2.0, 3)
    assert first == 0 and cdf[2] == pytest.approx(math.exp(-2) * 5)
    first, cdf = mixing.poisson_cdf(1e6, 10**9)
    assert cdf[10**6 - first] == pytest.approx(0.5, abs=1e-3)


@needs_vocabulary
def test_mixture(spark):
    rng = random.Random(0)
    docs = [(i, rng.choice(["A", " a ", "b", "B", "c"]), "word " * rng.randint(5, 50)) for i in range(4000)] + [(9000, None, "x"), (9001, " ", "x"), (None, "a", "x"), (9002, "a", None), (9003, "a", ""), (9004, "c", "long text " * 50_000), (0, "A", "short")]
    df = spark.createDataFrame([(*x, "t", 1, 2) for x in docs], DOCS)
    targets = [("m", 40_000, "a ", 0.5, 2), ("m", 40_000, "B", 0.25, 3), ("m", 40_000, "gone", 0.25, 3), ("n", 10_000_000, "a", 0.5, 3), ("n", 10_000_000, "b", 0.0, 3), ("o", None, "a", None, None), ("p", 1000, "a", 1.0, 0), (None, 1, "a", 1.0, 1)]
    m = mixing.Mixture(df, spark.createDataFrame([(*t, "r") for t in targets], TARGETS))
    assert {tuple(r) for r in m.short().collect()} == {("m", "gone"), ("n", "a"), ("p", "a")}
    shares = {(r.mixture, r.source): r for r in m.shares().collect()}
    assert shares["m", "a"].drawn_tokens == pytest.approx(20_000, rel=0.1) and shares["m", "b"].drawn_tokens == pytest.approx(10_000, rel=0.15)
    assert shares["n", "a"].drawn_tokens == 3 * shares["n", "a"].available_tokens and shares["n", "a"].most_uses == 3 and shares["m", "a"].most_uses <= 2
    assert shares["m", "gone"].drawn_tokens == 0 and shares["n", "b"].drawn_tokens == 0 and shares["p", "a"].drawn_tokens == 0
    rows = m.mixed().collect()
    assert len({(r.mixture, r.doc_id, r.copy_no) for r in rows}) == len(rows)
    own = [r.doc_id for r in rows if r.mixture == "m"]
    assert own != sorted(own) and [tuple(r) for r in rows] == [tuple(r) for r in mixing.Mixture(df.repartition(9), spark.createDataFrame([(*t, "r") for t in targets], TARGETS)).mixed().collect()]
    empty = mixing.Mixture(df.limit(0), spark.createDataFrame([(*t, "r") for t in targets], TARGETS))
    assert {tuple(r) for r in empty.short().collect()} == {("m", "a"), ("m", "b"), ("m", "gone"), ("n", "a"), ("p", "a")} and empty.mixed().count() == 0
    assert mixing.Mixture(df, spark.createDataFrame([], TARGETS)).mixed().count() == 0


@needs_vocabulary
def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = mixing.TOKENIZER.replace(".tiktoken", ".json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["Hello world", "", "<|endoftext|> ünï", "a" * 3000, " " * 100_000, "ab \n" * 50_000, "x" * 300_000, "ﬁ １２3's  \t it'S", None]
    docs = spark.createDataFrame([(i, "s", x) for i, x in enumerate(texts)], "doc_id bigint, source string, text string")
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    for vocabulary in (mixing.TOKENIZER, path):
        assert {r.doc_id: r.tokens for r in mixing.count_tokens(docs, vocabulary).collect()} == want


def test_disguises_come_off():
    t = toxicity.plain_tokens
    assert t("You 1d10t") == ["you", "idiot"] and t("sttttupid!") == ["stupid"] and t("V.E.R.M.I.N") == ["<spelt>", "vermin", "ermin"]
    assert t("b*****d") == ["<mask>", "b*d7"] and t("d1$gu$t1ng") == ["disgusting"] and t("bitсh") == ["<twin>", "bitch"] and t("12 3") == ["<num>", "<num>"]
    assert toxicity.sentences("s​tu​pid <b>ＹＯＵ</b>") == [["stupid"], ["you"]]
    assert toxicity.sentences("") == [] and toxicity.sentences(" . ! ") == [] and len(toxicity.sentences("word " * 5000)) > 100


CLEAN = ["The {a} stood by the {b}.", "A {a} weighs more than a {b}.", "Nobody saw the {a} near the {b}.", "The lesson lists rude words such as {x} and explains them."]
FOUL = ["You are a {x} and nobody wants you near the {a}.", "Crawl back into your hole, {x}.", "Your {a} smells, you {x} piece of dirt."]
NOUNS, BAD = "lamp bridge horse window river stone garden kettle".split(), "idiot moron bastard scumbag".split()


def labelled(spark, seed, n):
    rng = random.Random(seed)
    fill = lambda s: s.format(a=rng.choice(NOUNS), b=rng.choice(NOUNS), x=rng.choice(BAD))
    docs, labels = [], []
    for i in range(n):
        foul = rng.random() < 0.2
        parts = [fill(rng.choice(CLEAN)) for _ in range(rng.randint(2, 6))]
        if foul:
            parts.insert(rng.randrange(len(parts)), fill(rng.choice(FOUL)))
        docs.append((i, f"s{i % 2}", " ".join(parts), foul))
        if i % 2:
            wrong = rng.random() < 0.03
            labels.append((i, int(foul) ^ wrong))
    labels += [(1, None), (3, 1), (3, 0), (None, 1), (10**9, 1)]
    d = spark.createDataFrame([(*x[:3], "t", 0.5) for x in docs], "doc_id bigint, source string, text string, toxic string, score double")
    return docs, d, spark.createDataFrame([(*x, "w") for x in labels], "doc_id bigint, toxic int, text string")


def test_unlabelled_documents_are_judged_well(spark):
    docs, d, labels = labelled(spark, 3, 900)
    model = toxicity.fit(d, labels)
    scores = toxicity.score(d, model)
    got = {r.doc_id for r in toxicity.flagged(scores, model).collect()}
    held = [(i, foul) for i, _, _, foul in docs if i % 2 == 0]
    hit = sum(foul and i in got for i, foul in held)
    assert hit >= 0.9 * sum(f for _, f in held) and hit >= 0.9 * sum(i in got for i, _ in held)
    assert [tuple(r) for r in scores.orderBy("doc_id").collect()] == [tuple(r) for r in toxicity.score(d.repartition(5), toxicity.fit(d.repartition(3), labels)).orderBy("doc_id").collect()]
    rates = {r.source: r for r in toxicity.rates(scores, model).collect()}
    assert rates["s0"].n_docs == 450 and sum(r.n_flagged for r in rates.values()) == len(got)


def test_bounded_sample_and_odd_rows(spark):
    docs, d, labels = labelled(spark, 4, 400)
    model = toxicity.fit(d, labels, positives=20, negatives=40)
    assert 0 < model.cut < 1 and len(model.weights) == len(toxicity.CATEGORIES)
    odd = spark.createDataFrame([(1, None, None, 1), (None, " S ", "You are a idiot and nobody wants you near the lamp.", 1), (2, "s", "", 1), (3, "s", " \n", 1), (4, "s", "word " * 200_000, 1), (5, "s", "�<p>&nbsp;</p>", 1)], "doc_id bigint, source string, text string, insult int")
    rows = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert len(rows) == 6 and rows[1].score == rows[2].score == rows[3].score == 0.0 and rows[None].score > rows[4].score
    assert toxicity.flagged(toxicity.score(odd, model), model).filter("doc_id is null").count() == 0
    assert toxicity.score(odd.limit(0), model).count() == 0
    bare = toxicity.fit(d, labels.limit(0))
    assert toxicity.score(odd, bare).count() == 6 and toxicity.fit(d.limit(0), labels).cut == 0.5


def test_chain_feeds_earlier_links():
    keys = np.array([5], np.uint64)
    model = toxicity.ChainModel(keys, [np.array([4.0, -2.0]), np.array([0.0, 6.0, -3.0])], 0.5)
    out = model.sentence_scores(np.array([5, 7], np.uint64), np.array([0, 1]), 2)
    p = 1 / (1 + math.exp(-2))
    assert out[0, 0] == pytest.approx(p) and out[0, 1] == pytest.approx(1 / (1 + math.exp(-(6 * p - 3)))) and out[0, 1] > out[1, 1]


def test_words_between_angle_brackets_are_scored():
    flat = lambda t: [w for s in toxicity.sentences(t) for w in s]
    assert flat("so <you stupid idiot> there") == ["so", "you", "stupid", "idiot", "there"]
    assert flat("noon <evening. By dusk it had> gone <idiot>") == ["non", "evening", "by", "dusk", "it", "had", "gone", "idiot"]
    assert flat('<p>one</p><div class="x y" id=z>two<br/></DIV> <A href=\'u\'>four</a>') == ["one", "two", "four"]
