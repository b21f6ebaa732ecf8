import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from heddle.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "  two  spaces\n\n\tand tabs ", "don't we'll I'VE", "naïve œuvre Straße 12345 ½", "<|endoftext|> inside </s> <s> <unk>", "日本語 текст ‏עברית", "x" * 3000,
    "\x00\x1f\x85\xa0 ", "😀😀 é👩‍👩‍👧", "holds ▁ the mark", "the same text", "the same text", "ab 日本 " * 400, "the the the", "\r\n;\r\n", "0123456789" * 30,
]


def plain(texts):
    """The contract, token by token."""
    a_of, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    groups_of = []
    for text in texts:
        groups = []
        if text:
            a = [(i, bytes(byte_of[c] for c in a_of.id_to_token(i))) for i in a_of.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text) for p in [model.id_to_piece(i)]]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                def ends(side):
                    at, out = 0, []
                    for i, x in side:
                        at += len(x)
                        out.append((at, i))
                    return out
                a, b = ends(a), ends(b)
                start = 0
                for cut in sorted({e for e, _ in a} & {e for e, _ in b}):
                    groups.append(([i for e, i in a if start < e <= cut], [i for e, i in b if start < e <= cut], start, cut))
                    start = cut
        groups_of.append(groups)
    held, links_of = Counter(), []
    for groups in groups_of:
        links = Counter((x, y) for a, b, *_ in groups for x in a for y in b)
        links_of.append(links)
        held.update(links.keys())
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = []
    for groups, links in zip(groups_of, links_of):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, *_ in groups)
        rows.append((
            sum(len(a) for a, *_ in groups), sum(len(b) for _, b, *_ in groups), len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == most[k[0]]),
            sum(n * held[k] for k, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return rows, groups_of


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "row", b"links", 0.5) for i, t in enumerate(TEXTS)], "doc_id long, text string, row string, links binary, n_best double").repartition(3)


@pytest.mark.parametrize(("part", "chunk", "large"), [(1 << 22, 1 << 20, 1 << 10), (40, 1, 1)])
def test_rows_are_those_of_the_plain_version(docs, monkeypatch, part, chunk, large):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "LARGE", large)
    monkeypatch.setattr(alignment, "PART", part)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(docs, A, B, part).collect()}
    expected, _ = plain(TEXTS)
    assert len(got) == len(TEXTS)
    for i, row in enumerate(expected):
        assert got[i if i != 3 else None] == row, TEXTS[i]


def test_groups_cover_the_text_and_end_together(docs):
    got = defaultdict(list)
    for r in alignment.token_groups(docs, A, B).collect():
        got[r["doc_id"]].append((r["group"], r["a_ids"], r["b_ids"], r["start"], r["end"]))
    _, expected = plain(TEXTS)
    for i, groups in enumerate(expected):
        assert sorted(got[i if i != 3 else None]) == [(k, *g) for k, g in enumerate(groups)]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    assert alignment.token_groups(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
