import random
import re

import pytest
from pyspark.sql import functions as F

from heddle.operators import matching
from tests.test_whole_jobs import cut, distance, sound

WORDS = ["alpha", "beta", "gamma", "delta", "straße", "été", "one", "two", "x", "می", "kilometre", "of"]


def similar(a, b):
    return 1 - distance(a, b) / max(len(a), len(b), 1)


def plain(text, other, least=0.85):
    """All windows of all sentences, one by one."""
    said = [sound(s) for s in re.split(r"(?<=[.!?؟؛])\s+", text) if len(s.split()) >= 4]
    words, taken = sound(other).split(), []
    for no, s in enumerate(said):
        n = len(s.split())
        spans = [(0, len(words))] if len(words) <= n else [(i, i + w) for w in sorted({max(1, round(n * x)) for x in (0.8, 1.0, 1.2)}) for i in range(len(words) - w + 1)]
        best = None
        for i, j in spans if n else []:
            score = similar(s, " ".join(words[i:j]))
            if score >= least and all(j <= a or b <= i for _, a, b, _ in taken) and (best is None or score > best[3]):
                best = (no, i, j, score)
        if best:
            taken.append(best)
    return said, taken


def texts(seed, n=16):
    r = random.Random(seed)
    out = [" ".join(r.choice(WORDS) + r.choice(["", "", "", ".", "!", ","]) for _ in range(r.randrange(40))) for _ in range(n)]
    for k in range(1, n, 2):  # altered copies of the text before
        out[k] = "".join(c if r.random() > 0.03 else r.choice(["", "q", c + c]) for c in out[k - 1])
    return [*out, "", "Only three words. One two three four. One two three four.", "one two three four five", "One two three four. one two three four. one two three four", None, "ab. " * 30]


@pytest.mark.parametrize("seed", range(3))
def test_sentences_take_their_best_windows(spark, tmp_path, seed):
    said = texts(seed)
    folder = f"{tmp_path}"
    spark.createDataFrame([(k // 40, k, "user", t, 1) for k, t in enumerate(said)], "conv_id long, turn long, role string, text string, said int").write.parquet(f"{folder}/conversations.parquet")
    expected = {k: plain(a or "", b or "") for k, (a, b) in enumerate(zip(said, said[1:]))}
    got = {}
    for r in matching.t44_sentence_windows(spark, folder).collect():
        got[r["position"], r["sentence"]] = None if r["score"] is None else (r["first_word"], r["words"], round(r["score"], 9))
    assert got == {(k, no): next(((a, b - a, round(s, 9)) for n, a, b, s in taken if n == no), None) for k, (s, taken) in expected.items() for no in range(len(s))}
    missing = {r["position"]: (r["sentences"], r["missing"]) for r in matching.t34_missing_sentences(spark, folder).collect()}
    assert missing == {k: (len(s), len(s) - len(taken)) for k, (s, taken) in expected.items()}
    assert any(taken for _, taken in expected.values())


def test_verdicts(spark, tmp_path):
    said = ["This is one sentence. Here comes another one now.", "This is one sentence. Here comes another one now", "This is one sentence. And here is quite another text", "This is one sentence. And here is quite another text. The end is new here", "", "Hello to all of you.", "Hello to all of you"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(said)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["position"]: r for r in matching.t33_text_verdicts(spark, str(tmp_path)).collect()}
    for i, (a, b) in enumerate(zip(said, said[1:])):
        x, y = sound(a), sound(b)
        ratio = similar(x, y) if x and y else 0
        s, taken = plain(a, b)
        missing = len(s) - len(taken)
        verdict = "pass" if ratio >= 0.9 and not missing and not cut(x, y) else "manual_review" if ratio >= 0.78 and not cut(x, y) else "regenerate"
        assert (round(got[i]["similarity"], 9), got[i]["missing"], got[i]["truncated"], got[i]["verdict"]) == (round(ratio, 9), missing, cut(x, y), verdict), i
    assert got[0]["verdict"] == "pass" and got[1]["missing"] == 1


def fold(text):
    """(folded characters, place of each), character by character."""
    table = dict(zip(matching.ARABIC_FROM, matching.ARABIC_TO)) | {}
    marks = dict(zip(matching.MARKS_FROM, matching.MARKS_TO))
    out = []
    for at, c in enumerate(text):
        c = table.get(c, c)
        c = marks.get(c, c).lower().replace("…", "...").replace("ß", "ss")
        c = re.sub("[ \t\n\x0b\x0c\r\x1c-\x1f\x85\xa0  ]", " ", re.sub(matching.DROPPED, "", c))
        out += [(x, at) for x in c]
    kept = [p for k, p in enumerate(out) if p[0] != " " or k and out[k - 1][0] != " "]
    return kept[1:] if kept and kept[0][0] == " " else kept


def test_spans_are_of_the_original(spark):
    r = random.Random(4)
    alphabet = ["a", "b", "É", "ß", " ", " ", "\n", "“", "–", "‌", "­", "…", "ي", "٤", "ً", "😀", "İ"]
    rows = [("ss and", "Straße  AND"), (" ", "x"), ("", ""), (None, "a"), ("a", None), ("zz", "abc"), ("..", "wait… what"), ("b", " a  b")]
    for _ in range(120):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(30)))
        i, j = sorted((r.randrange(len(text) + 1), r.randrange(len(text) + 1)))
        rows.append((text[i:j], text))
    frame = spark.createDataFrame([(k, a, b, 1) for k, (a, b) in enumerate(rows)], "k int, excerpt string, text string, folded int")
    got = {x["k"]: (x["start"], x["end"]) for x in matching.located(frame, "excerpt", "text").select("k", "start", "end").collect()}
    found = 0
    for k, (excerpt, text) in enumerate(rows):
        needle, hay = "".join(c for c, _ in fold(excerpt or "")).rstrip(" "), fold(text or "")
        at = "".join(c for c, _ in hay).find(needle) if needle else -1
        assert got[k] == ((hay[at][1], hay[at + len(needle) - 1][1] + 1) if at >= 0 else (None, None)), (excerpt, text)
        if at >= 0:
            found += 1
            assert needle in "".join(c for c, _ in fold(text[got[k][0] : got[k][1]]))
    assert found > 80


def test_no_similar_window_is_left_out():
    from fractions import Fraction

    r = random.Random(9)
    for _ in range(60):
        words = [r.choice(WORDS[:9]) for _ in range(r.randrange(1, 25))]
        sentence = "".join(c if r.random() > 0.06 else r.choice(["", "z"]) for c in " ".join(words[2:9]))
        sentence = " ".join(sentence.split())
        near = set(matching.windows_near([sentence], words, Fraction(85, 100)))
        n = len(sentence.split())
        for w in sorted({max(1, round(n * x)) for x in (0.8, 1.0, 1.2)}):
            for i in range(len(words) - w + 1):
                if n and len(words) > n and similar(sentence, " ".join(words[i : i + w])) >= 0.85:
                    assert (0, i, i + w) in near


def test_few_windows_are_compared_and_none_is_lost():
    from fractions import Fraction

    r, least = random.Random(5), Fraction(17, 20)
    names = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(60)]
    words = [r.choice(names) for _ in range(300)]
    said = [" ".join(words[k : k + 9]) for k in range(0, 280, 14)]
    said = ["".join(c if r.random() > 0.06 else r.choice(["", "q", c + c]) for c in s) for s in said] + [" ".join(r.choice(names) for _ in range(7)) for _ in range(5)] + ["ab cd", "a", ""]
    got = set(matching.windows_near(said, words, least))
    every = {(no, i, i + w) for no, s in enumerate(said) if s for w in {max(1, round(len(s.split()) * x)) for x in matching.SCALES} for i in range(len(words) - w + 1)}
    near = {c for c in every if similar(said[c[0]], " ".join(words[c[1] : c[2]])) >= 0.85}
    assert near and near <= got <= every and len(got) < len(every) / 20
