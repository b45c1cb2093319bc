import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import leakage
from tallyforge.llm.leakage import MIN_RUN, MIN_TEMPLATE, Plan, Words, _Side, _verbatim_runs, bare, compare_slots, fold, full_template, lay, number_template, plan_for, safe_length, template_leaks, titled, too_dense, verbatim_leaks, window_hashes, winnow

ITEMS = [
    (1, "Let weighted_rental_rate be the quotient of coupon_amount and credit_note_status, formed even if 2 slips carry one key. Which of the two may be summed over 12 weeks?"),
    (2, "前年の返金を除いた再訪の割引比率は92で、企画の窓口の控えでは4.973e+05になる。純額の更新合計は同じ鍵の伝票が二枚あっても3521行を含み、無料で譲った席は129件だけ残る。"),
    (3, "too short"),
    (4, None),
    (5, "12345 67890 " * 20),
]


def brute(docs, items):
    grams = {}
    for i, t in items:
        b = bare(fold(t or ""))
        for k in range(len(b) - MIN_RUN + 1):
            grams.setdefault(b[k : k + MIN_RUN], set()).add(i)
    out = set()
    for d, t in docs:
        b = bare(fold(t or ""))
        for k in range(len(b) - MIN_RUN + 1):
            out |= {(d, i) for i in grams.get(b[k : k + MIN_RUN], ())}
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    docs = [(0, None), (1, ""), (2, " \n"), (3, "nothing here " * 40), (4, ITEMS[0][1]), (5, ITEMS[1][1].replace("の", "の​")), (6, "filler " * 30_000 + ITEMS[1][1][10:]), (7, ITEMS[0][1].upper()), (8, "7 1234567890" + "1234567890" * 12)]
    for n in range(40):
        t = r.choice([ITEMS[0], ITEMS[1]])[1]
        raw = r.randint(40, 100)
        a = r.randint(0, max(0, len(t) - raw))
        cut = t[a : a + raw]
        glue = r.choice(["", " ", "\n", "9", "x"])
        docs.append((100 + n, "some words before" + glue + r.choice([cut, " ".join(cut), cut.replace(" ", "\t")]) + glue + "and 17 after"))
    return docs


@pytest.mark.parametrize("items", [ITEMS[:4], ITEMS])
def test_found_equals_brute_force(spark, items):
    docs = corpus(len(items))
    df = spark.createDataFrame([*docs, docs[4], (None, ITEMS[0][1])], "doc_id bigint, text string").withColumn("item_id", F.lit(9)).withColumn("stretch", F.lit("clash"))
    it = spark.createDataFrame([*items, items[0]], "item_id bigint, text string").withColumn("doc_id", F.lit(9))
    got = sorted(tuple(r) for r in verbatim_leaks(df, "doc_id", "text", it, "item_id", "text").collect())
    assert got == brute(docs, items) and got
    assert verbatim_leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert verbatim_leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_plan_follows_the_items(spark):
    it = spark.createDataFrame(ITEMS[:4], "item_id bigint, text string")
    assert plan_for(it, "text").collapse
    assert not plan_for(spark.createDataFrame(ITEMS, "item_id bigint, text string"), "text").collapse


def test_reparameterised(spark):
    other = ITEMS[0][1].replace("weighted_rental_rate", "net_seat_cost").replace("coupon_amount", "visit_flag").replace("credit_note_status", "meal_fee").replace("12 weeks", "7 weeks")
    mixed = ITEMS[0][1].replace("coupon_amount", "weighted_rental_rate", 1).replace("12", "13")
    docs = spark.createDataFrame([(1, "Note. " + other), (2, ITEMS[0][1]), (3, "unrelated text " * 20)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in template_leaks(docs, "doc_id", "text", spark.createDataFrame(ITEMS[:4], "item_id bigint, text string"), "item_id", "text").collect()}
    assert {k: r.kind for k, r in got.items()} == {(1, 1): "reparameterised", (2, 1): "verbatim"}
    assert got[1, 1].changed_slots == 4
    twice = "Let a_b be the quotient of a_b and c_d, formed even if two slips carry one key, and again a_b over c_d at last."
    apart = twice.replace("a_b", "x_y", 1)
    assert compare_slots(fold(twice.replace("a_b", "x_y")), twice).consistent and not compare_slots(fold(apart), twice).consistent
    assert mixed != other


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1２ _.-円x9", max_size=160), st.integers(0, 80), st.text(alphabet="a1 _円", max_size=20), st.text(alphabet="a1 _円", max_size=20))
def test_a_long_run_shares_a_window(item, start, before, after):
    f = fold(item)
    run = bare(f)[start : start + MIN_RUN]
    if len(run) < MIN_RUN:
        return
    doc = before + run + after
    n = min(safe_length(f, MIN_RUN, True), MIN_RUN)
    plan = Plan(True, n // 2, n - n // 2 + 1) if n >= 16 else Plan(False, MIN_RUN // 2, MIN_RUN - MIN_RUN // 2 + 1)
    pairs = lambda w: set(zip(w[1].tolist(), w[2].tolist()))
    assert pairs(plan.windows(["9", fold(doc), "12 x"])) & pairs(plan.windows([f]))  # slots filled alike
    laid = lay(_Side(fold(doc), [], plan.collapse), _Side(f, [], plan.collapse), plan.width, verbatim_only=True).verbatim
    a, b = bare(fold(doc)), bare(f)
    assert laid >= MIN_RUN and any(a[i : i + laid] in b for i in range(len(a) - laid + 1))


def test_texts_worked_on_together_are_apart():
    plan = Plan(True, 10, 10)
    texts = [fold(t or "") for _, t in corpus(3)] + ["12", "34 円", ""]
    together = plan.windows(texts)
    for i, t in enumerate(texts):
        alone = plan.windows([t])
        mine = {x for x in zip(*(together[k][together[0] == i].tolist() for k in (1, 2, 3, 4)))}
        assert mine >= {x for x in zip(*(alone[k].tolist() for k in (1, 2, 3, 4)))} or len(t) < 200


def test_pieces():
    t = number_template(fold("Rate 1,234 of x"))
    assert len(t.tokens) == 4 + 1 + 3
    assert len(number_template("").tokens) == 0 and len(full_template("...").tokens) == 0
    h = window_hashes(np.arange(100), 10, 1)
    assert len(h) == 91 and (window_hashes(np.arange(5, 100), 10, 1) == h[5:]).all()
    picked = winnow(h, 8)
    assert (np.diff(picked) <= 8).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=200), st.integers(1, 12))
def test_winnowing_covers_every_span(values, span):
    h = np.array(values, np.uint64)
    at = winnow(h, span)
    want = {i + j for i in range(max(0, len(h) - span + 1)) for j in range(span) if h[i + j] == h[i : i + span].min()} if len(h) > span else set(range(len(h)))
    assert set(at.tolist()) == want


def test_slots_of_the_full_template():
    text = "Alice Smith paid 1,234.5e+06 USD for 3 tickets, and the net_cost of 総額の請求構成比は56店のうちに"
    t = full_template(fold(text), titled(text))
    slots = [(int(k) - leakage._NUMBER, fold(text)[a:b]) for k, a, b in zip(t.tokens, t.start, t.end) if k >= leakage._NUMBER]
    assert slots == [(1, "alice smith"), (0, "1,234.5e+06"), (2, "usd"), (0, "3"), (2, "tickets"), (1, "net_cost"), (3, "総額の請求構成比"), (0, "56"), (2, "店")]
    assert titled("THE PARIS Which of İstanbul") == [] and titled("Which Paris and New York") == [(6, 11), (16, 24)]
    assert len(full_template("_", []).tokens) == 0 and full_template("a_b_", []).tokens.tolist() == [leakage._NAME]


def test_word_problem_with_other_names():
    item = "Alice has 14 apples and gives 3 of them to Bob before she travels from Paris to Rome by train. How many apples does Alice have left, and how many did Bob get?"
    put = lambda **names: " ".join(names.get(w.strip(".,?"), w.strip(".,?")) + w[len(w.rstrip(".,?")) :] for w in item.split())
    told = lambda doc: lay(_Side(fold(doc), titled(doc)), _Side(fold(item), titled(item)), 20)
    again = told("So: " + put(Alice="Carol", Bob="David", Paris="Oslo", Rome="Lisbon").replace("14", "27"))
    assert again.consistent and again.tokens >= MIN_TEMPLATE and again.verbatim < MIN_RUN
    mixed = put(Bob="David", Paris="Oslo", Rome="Lisbon").replace("Alice", "Carol", 1)
    assert not told(mixed).consistent  # one name for two


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARACTERS", 100)
    docs = corpus(3)
    got = sorted(tuple(r) for r in verbatim_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame(ITEMS, "item_id bigint, text string"), "item_id", "text").collect())
    assert got == brute(docs, ITEMS)


BENCHMARK = "/root/testdata/sf0.1/benchmark.parquet"


@pytest.mark.skipif(not os.path.isdir(os.path.dirname(BENCHMARK)), reason="the tables are not here")
def test_recall_of_items_asked_again(spark):
    """Every item again with other numbers, and with other names of its own kind: at least nine in ten are found."""
    r = random.Random(1)
    items = spark.read.parquet(BENCHMARK)
    texts = [(x.item_id, x.text) for x in items.collect() if x.text]
    kinds = [r"[一-鿿々ァ-ヶー]{2,}(?:の[一-鿿々ァ-ヶー]+)+", r"[a-z]+(?:_[a-z]+)+"]
    pools = [sorted({m for _, t in texts for m in re.findall(k, t)}) for k in kinds]
    again = []
    for i, t in texts:
        t = re.sub(r"\d+", lambda m: "".join(r.choice("123456789") for _ in m[0]) + r.choice(["", "7"]), t)
        again.append((i, t))
        for kind, pool in zip(kinds, pools):
            other = {m: r.choice(pool) for m in dict.fromkeys(re.findall(kind, t))}
            t = re.sub(kind, lambda m: other[m[0]], t)
        again.append((1000 + i, t))
    docs = spark.createDataFrame([(i, "前置き。 " + t + " and so on") for i, t in again], "doc_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in template_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    found = [sum((i + more, i) in got for i, _ in texts) / len(texts) for more in (0, 1000)]
    assert found[0] >= 0.99 and found[1] >= 0.9, found


def _renamed(seed):
    """An item of many long names and the same with other names of other lengths: 72 tokens between unlike words."""
    r = random.Random(seed)
    name = lambda: "_".join("".join(r.choice("bcdfghjk") for _ in range(r.randint(6, 9))) for _ in range(4))
    fill = r.sample(["of", "by", "on", "in", "at", "to", "up", "so", "is", "as"], 10)
    item, other = [], []
    for k in range(24):
        item += [name(), fill[k % 10]]
        other += [name(), fill[k % 10]]
    return "zzzz " + " ".join(item) + " zzzz", "yyyy " + " ".join(other) + " yyyy"


def test_long_names_keep_the_whole_template_run(spark):
    pairs = [_renamed(n) for n in range(30)]
    docs = spark.createDataFrame([(n, d) for n, (_, d) in enumerate(pairs)], "doc_id bigint, text string")
    items = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(pairs)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in template_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    for n, (i, d) in enumerate(pairs):
        assert got[n, n].kind == "reparameterised" and got[n, n].template_tokens == compare_slots(fold(d), i).tokens >= MIN_TEMPLATE


def test_verbatim_search_has_names_and_units_as_slots(spark):
    items = spark.createDataFrame(ITEMS[:4], "item_id bigint, text string")
    plan = plan_for(items, "text", verbatim_only=True)
    assert {"weighted", "rental", "coupon", "amount"} & set(plan.words.names) and {"slips", "weeks", "行"} <= set(plan.words.units)
    kept = [w for w in ("weighted", "rental", "coupon", "amount", "credit", "status") if w in plan.words.names]
    item = fold(ITEMS[0][1])
    assert {leakage._NUMBER, leakage._NAME, leakage._UNIT} <= set(number_template(item, words=plan.words).tokens.tolist())
    other = item.replace(kept[0], kept[-1]).replace("slips", "weeks").replace("12", "7")
    alike = lambda t, k: {x for x in zip(*(c.tolist() for c in plan.windows([t])[1 : 2 + k]))}
    assert alike(other, 0) == alike(item, 0) and alike(other, 1) != alike(item, 1)  # one template, other fillings
    a, b = (_Side(t, [], True, plan.words) for t in (fold("So " + ITEMS[0][1]), item))
    assert lay(a, b, plan.width, verbatim_only=True).slots >= 4 and lay(a, b, plan.width, verbatim_only=True).consistent
    docs = spark.createDataFrame([(1, ITEMS[0][1].replace(kept[0], kept[-1])), (2, "So " + ITEMS[0][1])], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in verbatim_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()) == brute([tuple(r) for r in docs.collect()], ITEMS[:4])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabbc12 _-", min_size=70, max_size=160), st.integers(0, 80), st.text(alphabet="abc1 _", max_size=20), st.text(alphabet="abc1 _", max_size=20), st.lists(st.text(alphabet="abc", min_size=3, max_size=9), max_size=6), st.lists(st.text(alphabet="abc", min_size=1, max_size=5), max_size=4))
def test_a_long_run_shares_a_window_with_names_and_units(item, start, before, after, names, units):
    run = bare(fold(item))[start : start + MIN_RUN]
    words = Words(tuple(sorted(set(names))), tuple(sorted(set(units))))
    n = min(safe_length(item, MIN_RUN, True, words), MIN_RUN)
    if len(run) < MIN_RUN or n < 2:
        return
    plan = Plan(True, n // 2, n - n // 2 + 1, verbatim_only=True, words=words)
    doc = before + run + after
    pairs = lambda w: set(zip(w[1].tolist(), w[2].tolist()))
    assert pairs(plan.windows(["9 a", doc, "12 x"])) & pairs(plan.windows([item]))
    laid = lay(_Side(doc, [], True, words), _Side(item, [], True, words), n, verbatim_only=True)
    a, b = bare(doc), bare(item)
    assert _verbatim_runs(plan.alike(["9 a", doc, "12 x"]), plan.alike(["", item]), n)[1, 1] == (laid.verbatim, laid.tokens, laid.slots)
    assert laid.consistent and laid.verbatim >= MIN_RUN and any(a[i : i + laid.verbatim] in b for i in range(len(a) - laid.verbatim + 1))


def test_names_that_fill_a_run_are_left_out():
    text = "gross_ticket_count over net_refund_share by gross_ticket_count over net_refund_share by gross_ticket_count, in all"
    words = Words(("count", "gross", "net", "refund", "share", "ticket"), ())
    assert safe_length(text, MIN_RUN, True, words) < leakage.LEAST_TOKENS
    out = too_dense(text, MIN_RUN, words)
    assert out and safe_length(text, MIN_RUN, True, Words(tuple(w for w in words.names if w not in out), ())) >= leakage.LEAST_TOKENS
