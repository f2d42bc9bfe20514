import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import DATA
from tracemill.llm import weak_quality as wq

GOOD = "The keeper of the light walked down to the shore, and the sea was calm that morning. It was a good day for the boats in the bay, she said to him."


def varied(i):
    """Good prose of words of its own."""
    r = np.random.default_rng(i)
    s = [" ".join(["The", *("".join(r.choice(list("abcdefghilmnoprstu"), r.integers(2, 8))) for _ in range(6)), "of", "the", "and", "".join(r.choice(list("aeioulnrst"), 6))]) + "." for _ in range(6)]
    return " ".join(s)


PICTURES = "\u2605\u2665 \U0001f600\U0001f525 \u2014 \u2022 " * 12
JUNK = ["#### $$$$ %%%% &&&& **** ==== " * 8, "BUY!! NOW!! CHEAP!! DEALS!! " * 12, "same line here\n" * 40, "word word word word word word word word " * 8, " | ".join(f"cell{i}" for i in range(60))]


def slow_em(votes, n_iter=wq.ITERATIONS):
    """EM a document at a time, over votes of -1, 0 and 1."""
    q = [0.05 if (v == -1).sum() >= 2 else 0.3 if (v == -1).any() else 0.95 for v in votes]
    for _ in range(n_iter):
        prior = (sum(q) + 1) / (len(q) + 2)
        theta = {}
        for y in (0, 1):
            w = [p if y else 1 - p for p in q]
            for r in range(votes.shape[1]):
                a = sum(x for x, v in zip(w, votes) if v[r] == -1) + 1
                b = sum(x for x, v in zip(w, votes) if v[r] == 1) + 1
                theta[y, r, -1], theta[y, r, 1] = a / (a + b), b / (a + b)
        new = []
        for v in votes:
            odds = np.log(prior / (1 - prior)) + sum(np.log(theta[1, r, x] / theta[0, r, x]) for r, x in enumerate(v) if x)
            new.append(1 / (1 + np.exp(-odds)))
        done = max(abs(a - b) for a, b in zip(q, new)) < wq.TOLERANCE
        q = new
        if done:
            break
    return np.array(q)


def test_codes_round_trip():
    v = np.random.default_rng(0).integers(0, 3, (50, len(wq.RULES))).astype(np.int8)
    assert np.array_equal(wq.decode(wq.encode(v)), v)


def test_measures_by_hand():
    m = wq.measures(pa.array(["Ab cd. Ab!", "", None, "É x\ny z\ny z", "|  | a"]))
    assert m["words"].tolist() == [3, 0, 0, 6, 3]
    assert m["mean_word"][0] == 8 / 3 and np.isnan(m["mean_word"][1])
    assert m["capital_share"][0] == 2 / 6 and m["bang_share"][0] == 1 / 3
    assert m["line_repeat_share"][3] == 3 / 10 or abs(m["line_repeat_share"][3] - 3 / 10) < 1e-9
    assert m["bar_share"][4] == 2 / 3
    assert m["capital_share"][3] > 0


def test_em_is_that_of_single_documents(make):
    texts = [varied(i) for i in range(60)] + JUNK * 3 + [GOOD, "", None, "Hi."]
    rows = {r.doc_id: r for r in wq.score_quality(make(texts)).collect()}
    votes = np.array([[{"vote": rows[i][f"vote_{n}"]}["vote"] for n in wq.NAMES] for i in range(len(texts))])
    q = slow_em(votes)
    assert np.allclose([rows[i].quality for i in range(len(texts))], q, atol=2e-6)
    assert all(rows[i].keep for i in range(60))
    assert not any(rows[i].keep for i in range(60, 75))


def test_filter_keeps_columns_and_clean_documents(make):
    texts = [varied(i) for i in range(40)] + JUNK * 2
    kept = wq.filter_quality(make(texts, {"quality": "clash", "keep": "x", "code": "y"}))
    assert kept.columns[-3:] == ["quality", "keep", "code"]
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_odd_rows(make):
    docs = [(1, None), (2, ""), (3, " \n "), (None, GOOD), (4, GOOD), (4, GOOD), (5, varied(1) * 900)]
    rows = wq.score_quality(make(docs)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.quality, r.keep, r.vote_length))
    assert len(rows) == 7 and len(set(by[4])) == 1 and by[None] == by[4][:1]
    assert by[1] == by[2] == by[3] and by[1][0][2] == -1
    assert wq.score_quality(make([])).count() == 0 and wq.filter_quality(make([])).count() == 0


def test_any_names_and_ids(make, spark):
    from pyspark.sql import functions as F

    texts = [varied(i) for i in range(40)] + JUNK * 2
    odd = {"__votes": "a", "__code": "b", "votes": "c", "CODE": "d", "__quality": "e", "tick`s": "f", "a.b": "g"}
    docs = make(texts, {k: v for k, v in odd.items() if "`" not in k and "." not in k}).withColumn("tick`s", F.lit("f")).withColumn("a.b", F.lit("g"))
    rows = wq.filter_quality(docs).collect()
    assert wq.filter_quality(docs).columns == docs.columns
    assert sorted(r.doc_id for r in rows) == list(range(40)) and all({k: r[k] for k in odd} == odd for r in rows)
    text_ids = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {r.doc_id for r in wq.score_quality(text_ids).collect() if r.keep} == {f"d{i}" for i in range(40)}


@pytest.mark.parametrize("text", [
    "Смотритель маяка спустился к берегу, и море в то утро было спокойным. Он сказал, что день хорош для лодок в заливе, и пошёл обратно в дом.",
    "نزل حارس المنارة إلى الشاطئ وكان البحر هادئا في ذلك الصباح. قال إن اليوم جيد للقوارب في الخليج ثم عاد إلى بيته الصغير قرب الماء.",
    "灯塔的看守人走到岸边，那天早上海面很平静。他说今天对海湾里的船来说是个好日子。 然后他回到了水边的小屋，点起了灯。",
    "ผู้ดูแลประภาคารเดินลงไปที่ชายฝั่ง ทะเลเช้าวันนั้นสงบ เขาบอกว่าวันนี้เป็นวันที่ดีสำหรับเรือในอ่าว",
    "Ο φύλακας του φάρου κατέβηκε στην ακτή και η θάλασσα ήταν ήρεμη εκείνο το πρωί. Είπε πως ήταν καλή μέρα για τις βάρκες.",
])
def test_prose_of_other_scripts_has_no_bad_vote(make, text):
    assert not (wq.votes(pa.array([text])) == wq.BAD).any()
    docs = [varied(i) for i in range(40)] + JUNK * 2 + [text]
    assert {r.doc_id: r.keep for r in wq.score_quality(make(docs)).collect()}[50]


def test_pictures_are_no_letters():
    vote = dict(zip(wq.NAMES, wq.votes(pa.array([PICTURES + "sale prices"]))[0]))
    assert vote["letters"] == wq.BAD and vote["function_words"] == wq.BAD


def test_against_labels(spark):
    rows = wq.op8_weak_quality(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality and r[-2] == 1], [r for r in rows if r[-2] == 0]
    assert sum(r.keep for r in good) >= 0.98 * len(good)
    assert sum(not r.keep for r in bad) >= 0.9 * len(bad)
