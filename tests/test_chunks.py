"""Chunks against a plain scan: none too long without need, no quotation cut, linear time."""

import random
import re
import time

from lexiloom.operators import rules

MARKS = '"“”＂'


def chunks_by_hand(text, most):
    """Places of allowed cuts first, then greedy packing over them."""
    pairs = [m.span() for m in re.finditer(f"[{MARKS}][^{MARKS}]*[{MARKS}]", text)]
    free = lambda at: not any(a < at < b for a, b in pairs)
    ends = [m.end() for m in re.finditer(r"[.!?]+[^\S\n]*\n*|\n+", text) if re.search(r"\s\Z", text[: m.end()]) and free(m.end())]
    commas = [m.end() for m in re.finditer(",", text) if free(m.end())]
    ends = sorted({e for e in ends if e < len(text)} | {len(text)})
    done, chunk, last, sentence = [], 0, 0, 0
    for end in ends:
        if end - sentence <= most:
            if end - chunk > most and last > chunk:
                done.append(last)
                chunk = last
        else:
            if last > chunk:
                done.append(last)
                chunk = last
            before = sentence
            for place in [*[c for c in commas if sentence < c < end], end]:
                if place - chunk > most and before > chunk and before > sentence:
                    done.append(before)
                    chunk = before
                before = place
        last = sentence = end
    return [text[a:b] for a, b in zip([0, *done], [*done, len(text)], strict=True)] if text else []


def test_chunks_equal_a_plain_scan(spark):
    rng, texts = random.Random(9), ["", "x", '"', "no marks at all " * 5, 'He said "one. Two. Three." Then, four. "open. end', "a,b,c,d,e,f,g,h.", "３．“가. 나. 다.” 라.\n마"]
    for _ in range(300):
        texts.append("".join(rng.choice(["word", " ", " ", ". ", ", ", ",", "! ", "?", "\n", '"', "“", "”", "3.14", "é"]) for _ in range(rng.randint(1, 80))))
    for most in (8, 20, 60):
        df = spark.createDataFrame([*enumerate(texts), (None, "a. b."), (9999, None)], "doc_id long, text string")
        got = {}
        for r in rules.chunk_documents(df, most).orderBy("doc_id", "chunk_id").collect():
            got.setdefault(r.doc_id, []).append(r.text)
        assert got.pop(None) == ["a. b."]
        assert got == {k: c for k, t in enumerate(texts) if (c := chunks_by_hand(t, most))}


def test_no_quotation_is_cut_and_long_texts_are_quick(spark):
    text = ('Some words here, "a quotation. With two sentences." And more of it. ' * 31000)[:2_000_000]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rules.chunk_documents(df.limit(0), 8000).count()
    began = time.time()
    got = [r.text for r in rules.chunk_documents(df, 8000).orderBy("chunk_id").collect()]
    assert time.time() - began < 20  # alone on the machine under 3
    assert "".join(got) == text and max(map(len, got)) <= 8000 and all(c.count('"') % 2 == 0 for c in got[:-1])
