import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tests.conftest import SF
from trefoil.llm import packing as P
from trefoil.llm import queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(rooms, x)
        n += i == len(rooms)
        room = (capacity if i == len(rooms) else rooms.pop(i)) - x
        if room:
            insort(rooms, room)
    return n


def test_word_encoder_equals_the_tokenizer():
    t, e = Tokenizer.from_file(PATH), P.WordEncoder(PATH)
    texts = ["a | b||c <|endoftext|> x<|STARTOFTEXT|>'s it's. don't,, É.é", "a|b |", "plain's I'LL, x.y 3.14,5 ''' İ Á. é,x ΑΣ. \xa0b", "", None, " \t", "word " * 3000, "é. ́x, É,"]
    ids, bounds = e.encode(pa.array(texts))
    for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 0]


def fuzzed(n, seed):
    """Short texts of awkward characters: every letter before a full stop and a comma, marks, cases, odd spaces, surrogate-free planes."""
    rng = random.Random(seed)
    letters = [chr(c) for c in range(0x80, 0x2FFF) if chr(c).isalpha()]
    odd = [*"İıßſŉǰΐΣςσΑ'’.,|<>\xa0\u2028\u200b\u0300\u0301\u0307\u0345\x1c\x85\t\n ", "'s", "'LL", "<|", "|>", "😀", "٣", "½", "Ⅷ", "中"]
    plain = "abcXYZ .,'12-"
    out = [f"{c}{p}{d}" for c in letters for p, d in ((".", ""), (",", "x"))]
    while len(out) < n:
        out.append("".join(rng.choice(rng.choice((letters, odd, odd, plain, plain))) for _ in range(rng.randint(1, 12))))
    return out[:n]


def agree(texts):
    t, e = Tokenizer.from_file(PATH), P.WordEncoder(PATH)
    for i in range(0, len(texts), 50):
        some = texts[i : i + 50]
        ids, bounds = e.encode(pa.array(some))
        for text, found, a, b in zip(some, t.encode_batch(some, add_special_tokens=False), bounds, bounds[1:], strict=False):
            assert ids[a:b].tolist() == [*found.ids, 0], ascii(text)


def test_capitals_with_marks_equal_the_tokenizer():
    agree(["T\u0308", "H\u0331 J\u030c W\u030a Y\u030a", "mit H\u0331amas.", "plain X. " + "K\u0331. x,", "\u212a\u0301 \u212b."])
    marks = [chr(c) for c in range(0x300, 0x370)]
    agree([f"{chr(c)}{m} a{chr(c)}{m}." for c in range(65, 91) for m in marks])


def test_fuzzed_texts_equal_the_tokenizer():
    agree(["İ.", "ABİ, ok", "TÜRKİYE'Yİ.", "a.Σ ΑΣ. ΑΣ.Α É. é, ß. ſ."])
    agree(fuzzed(30_000, 1))


def test_plan_places_every_piece_once():
    rng = random.Random(3)
    for case in range(8):
        capacity = rng.choice([8, 64, 2048])
        counts = {x: rng.choice([1, 2, 7, 300]) for x in rng.sample(range(1, capacity + 1), min(capacity, rng.choice([1, 5, 60, 400])))}
        seen, filled = defaultdict(list), defaultdict(list)
        for length, a, b, first, at in P.plan(counts, capacity):
            seen[length].append((a, b))
            for i in range(b - a):
                filled[first + i].append((at, length))
        for length, n in counts.items():
            runs = sorted(seen[length])
            assert runs[0][0] == 0 and runs[-1][1] == n and all(x[1] == y[0] for x, y in zip(runs, runs[1:], strict=False)), case
        for parts in filled.values():
            end = 0
            for at, length in sorted(parts):
                assert at == end
                end += length
            assert end <= capacity
        assert sorted(filled) == list(range(len(filled)))
        total = [x for x, n in counts.items() for _ in range(n)]
        assert len(filled) <= best_fit(total, capacity)
    assert P.plan({}) == []


def test_configurations_beat_singles():
    found = P.configurations([6, 5, 3], [100, 100, 100], 11)
    assert sum(n for _, n in found) <= 134
    assert all((pattern * np.array([6, 5, 3])).sum() <= 11 for pattern, _ in found)


def test_query_round_trip(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs.items()}
    got = queries.op5_best_fit_packing(spark, SF).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        own = sorted(pieces[i])
        assert [p[0] for p in own] == list(range(-(-len(x) // 2048))) and sum(p[2] for p in own) == len(x) and all(p[2] == 2048 for p in own[:-1])
    for parts in places.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= 2048
    assert len(places) <= best_fit([p[2] for own in pieces.values() for p in own], 2048)


def test_nulls_repeats_clashing_columns_and_sequences(spark):
    data = [(1, None, 1, "a"), (1, None, 2, "b"), (2, "", 3, "c"), (None, "one two three", 4, "d"), (4, "word " * 5000, 5, "e"), (4, "word " * 5000, 6, "f")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, rank int, sequence_id string")
    packed = P.pack(P.tokenize(df, PATH, 64, keep_ids=True), capacity=64)
    rows = packed.collect()
    assert sum(r.length for r in rows) == 3 + 4 + 2 * 5001 and [r.ids for r in rows if r.doc_id in (1, 2)] == [[0]] * 3
    lines = P.sequences(packed).collect()
    assert sorted(i for line in lines for i in line.ids) == sorted(i for r in rows for i in r.ids) and max(len(line.ids) for line in lines) <= 64
    assert P.pack(P.tokenize(df.limit(0), PATH)).collect() == []
