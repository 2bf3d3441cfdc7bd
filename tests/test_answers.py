"""Fuzzy search by seeds equals the sliding window; the store of answers."""

import difflib
import random

import pytest

from weftgraph.functions import text as txt
from weftgraph.plans import provider


def sliding(text, doc):
    """Every window compared."""
    if len(text) <= txt.FUZZY_OVER:
        return -1
    best, at = txt.FUZZY_RATIO, -1
    for i in range(0, max(1, len(doc) - len(text) + 1), max(1, len(text) // 4)):
        r = difflib.SequenceMatcher(None, doc[i : i + len(text) + txt.FUZZY_MARGIN], text, autojunk=True).ratio()
        if r >= best and (r > best or at < 0):
            best, at = r, i
    return at


@pytest.mark.parametrize("seed", range(60))
def test_seeds_find_what_the_window_finds(seed):
    r = random.Random(seed)
    alphabet = ["ab", "abcd ", "the quick brown fox ", "éü\U0001f600x "][seed % 4]
    doc = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 900)))
    n = r.randrange(15, 300)
    k = r.randrange(len(doc) + 1)
    out = list(doc[k : k + n])
    for _ in range(int(len(out) * r.choice([0, 0.02, 0.06, 0.12, 0.2]))):
        at = r.randrange(len(out) + 1)
        if r.random() < 0.5 and at < len(out):
            del out[at]
        else:
            out.insert(at, r.choice(alphabet + "#"))
    text = "".join(out)
    assert txt.fuzzy_find(text, doc) == sliding(text, doc)


def test_few_windows_are_compared():
    r = random.Random(0)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    doc = " ".join(r.choice(words) for _ in range(40_000))
    text = doc[37 * 2703 : 37 * 2703 + 150].replace("e", "3", 1)
    assert len(txt.windows(text, doc)) < 12 < len(doc) // 37 // 500 and 37 * 2703 in txt.windows(text, doc)


def Once(path, broken=None):  # noqa: N802  a class of its own, so that workers get it by value
    """Answers all but one key and writes down what it was asked."""

    class Model:
        def answer(self, key, prompt):
            with open(path, "a") as f:
                f.write(key + "\n")
            if key == broken:
                raise ValueError("broken")
            return f"{key}: {prompt}", 1, 1

    return Model()


def test_a_store_asks_what_is_missing(spark, tmp_path):
    log, store = tmp_path / "log", provider.AnswerStore(spark, str(tmp_path / "answers"))
    asked = lambda: sorted(log.read_text().split()) if log.exists() else []
    df = lambda **p: spark.createDataFrame(list(p.items()), "key string, prompt string")
    rows = lambda x: {r["key"]: (r["response"], r["error"]) for r in x.collect()}
    assert rows(store.answers(df(a="1"))) == {"a": (None, "not asked")}
    got = rows(store.ask(df(a="1", b="2", c="3"), Once(log, "b"), wave=1))
    assert got == {"a": ("a: 1", None), "b": (None, "ValueError: broken"), "c": ("c: 3", None)} and asked() == ["a", "b", "c"]
    log.unlink()
    # the next run asks the failure, the changed prompt and the new one
    got = rows(store.ask(df(a="1", b="2", c="other", d="4"), Once(log), concurrency=3, per_second=1000))
    assert got == {"a": ("a: 1", None), "b": ("b: 2", None), "c": ("c: other", None), "d": ("d: 4", None)} and asked() == ["b", "c", "d"]
    log.unlink()
    store.ask(df(a="1", b="2"), Once(log))
    assert asked() == []


def test_a_store_survives_a_run_that_broke_off(spark, tmp_path):
    store = provider.AnswerStore(spark, str(tmp_path / "answers"))
    prompts = spark.createDataFrame([(f"k{i}", "p") for i in range(20)], "key string, prompt string")
    kept, seen = store.add, []

    def add(rows, name=None):
        if len(seen) == 2:
            raise KeyboardInterrupt
        seen.append(1)
        kept(rows, name)

    store.add = add
    with pytest.raises(KeyboardInterrupt):
        store.ask(prompts, Once(tmp_path / "log"), wave=5)
    store.add = kept
    done = 20 - store.missing(prompts).count()
    (tmp_path / "log").unlink()
    assert 0 < done < 20 and store.ask(prompts, Once(tmp_path / "log"), wave=5).filter("error is null").count() == 20
    assert len((tmp_path / "log").read_text().split()) == 20 - done


def test_calls_are_paced():
    clock, waits = [0.0], []

    def wait(seconds):
        waits.append(round(seconds, 6))
        clock[0] += seconds

    pace = provider.Pace(4, lambda: clock[0], wait)
    for _ in range(3):
        pace.take()
    clock[0] += 10
    pace.take(), pace.take()
    assert waits == [0.25, 0.25, 0.25]
