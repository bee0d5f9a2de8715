"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes that adds spans.

The patterns are email addresses, IP addresses, payment cards and international phone numbers. The field reads the
words between white space as shapes (length, kinds of characters, digits, changes between letters and digits,
leading zero, key words), with those of both neighbours and the key words and digits a little further off, and labels secrets, national ids, bank accounts and local phone
numbers. It is trained from a small labelled table and decoded by Viterbi in numpy batches: words that are outside
any span in every best path are settled by a bound first, so only short stretches are left to decode. Pattern spans stay; the
field's spans are added where they overlap none.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; very long texts
are read whole; repeated rows are searched each on its own; only the named columns are read; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from trefoil.llm import crf
from trefoil.llm.words import bounded_batches, characters, letters, slices, split

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the field adds; label 0 is outside.
ADDED_KINDS = ("secret", "national_id", "bank_account", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A new run of digits starts at its first one; what is left of a matched run is none.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Words that announce what follows.
KEYWORDS = (
    "token key api_key apikey secret secret_key password passwd passphrase pwd passwort kennwort contraseña clave bearer access_key".split(),
    "ssn social passport nif dni steuernummer insee id_number".split(),
    "iban account konto kontonummer compte cuenta".split(),
    "tel phone call ring dial telephone telefon téléphone teléfono mobile fax".split(),
)
#: Every word that announces a value.
NAMES = frozenset(w for some in KEYWORDS for w in some)
#: A name and its sign before a value, in one word with it.
NAMED = re.compile(r"[^\w]*(\w+)[\"'\])]*[=:]+")
#: Upper bounds of the length classes; of few digits every number has its own, as dates differ from ids by one digit.
LENGTHS = (1, 2, 3, 4, 6, 7, 8, 9, 10, 12, 15, 19, 25, 33, 47)
SEED, ROUNDS = 11, 250

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Every @ with the longest run of local characters before it and a domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str, digits: bool = True) -> list[Span]:
    """The pattern spans by start, then kind. ``digits=False`` says that the text has none."""
    out = _emails(text) if "@" in text else []
    if digits:
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            number = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(number) <= 19 and _luhn(number):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def labelled_table(copies: int = 6) -> list[tuple[str, list[Span]]]:
    """The small training table: sentences with marked spans, filled in by a fixed rule."""
    rng = random.Random(SEED)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    digits, hexes, upper = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fill = {
        "hex": lambda: pick(hexes, rng.choice([32, 40, 40, 40, 64])), "HEX": lambda: pick(hexes.upper(), 40), "b64": lambda: pick(upper + upper.lower() + digits, rng.randint(20, 44)), "pass": lambda: pick(upper.lower(), 4) + pick(digits, 3) + "!x" + pick(upper, 2),
        "d3": lambda: pick(digits, 3), "d2": lambda: pick(digits, 2), "d4": lambda: pick(digits, 4), "d6": lambda: pick(digits, 6), "iban": lambda: pick(upper, 2) + pick(digits, rng.choice([18, 20, 22])), "pp": lambda: pick(upper, 1) + pick(digits, 8),
        "uuid": lambda: "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)), "ak": lambda: pick(upper, 5) + pick(upper + digits, rng.randint(13, 17)) + pick(digits, 1) + pick(upper, 1), "ib": lambda: pick(upper, 2) + pick(digits, 2), "mix": lambda: pick(upper + upper.lower(), 4) + pick(":=-_/+!?", 1) + pick(upper + upper.lower() + digits, rng.randint(6, 16)) + pick(digits, 2), "year": lambda: rng.choice(["19", "20"]) + pick(digits, 2), "mm": lambda: f"{rng.randint(1, 12):02d}", "env": lambda: rng.choice(["password", "token", "api_key", "DB_PASSWORD", "secret", "access_key"]),
        "bic": lambda: pick(upper, 4), "d1": lambda: pick(digits, 1), "d5": lambda: pick(digits, 5), "d7": lambda: pick(digits, 7), "d8": lambda: pick(digits, 8), "acct": lambda: pick(digits, rng.randint(7, 12)), "L": lambda: pick(upper, 1), "short": lambda: pick(upper.lower(), rng.randint(4, 9)) + pick(digits, rng.randint(1, 4)), "Short": lambda: pick(upper, 1) + pick(upper.lower(), rng.randint(3, 7)) + pick(digits, rng.randint(1, 4)) + pick("!?#", rng.randint(0, 1)),
        "cloud": lambda: pick(upper, rng.randint(8, 13)) + pick(digits, rng.randint(1, 2)) + pick(upper, rng.randint(5, 8)), "pre": lambda: pick(upper.lower(), rng.randint(2, 4)) + pick("_-", 1), "alt": lambda: "".join(pick(upper, 1) + pick(digits, 1) for _ in range(rng.randint(2, 6))), "of": lambda: rng.choice(["is", "no.", "number", "nr.", ":", "was", "ist", "est", "es"]), "first": lambda: rng.choice("6789"),
        "card": lambda: pick(digits, 16), "w": lambda: pick("etaoinshrdlu", rng.randint(1, 9)), "W": lambda: pick(upper, rng.randint(2, 9)), "n": lambda: pick(digits, rng.randint(1, 4)), "ü": lambda: pick("äéñßçchten", rng.randint(2, 10)),
    }
    templates = [
        'token = {secret "#hex"} #w #w', 'api_key = {secret "#hex"} and #w', '#w #w. TOKEN = {secret "#HEX"}!! #W!! #W!!', 'secret : {secret #b64} #w', 'password = {secret #pass} #w', '#w key = {secret #b64} #w', 'password: {secret #pass}', 'key = {secret "#hex"}### #w*** #w&&& #w%%%', 'pwd = {secret #pass}',
        "#w secret : {secret #mix} #w", "password = {secret #mix}", 'token = {secret "#mix"}, #w', "#env={secret #mix} #w", "#env={secret #hex}", '#w {secret #hex} #w', "#w #w {secret #HEX}.", "commit {secret #hex} #w", "#w {secret #uuid} #w", 'id {secret "#uuid"}, #w', "bearer {secret #b64}", "#w {secret #ak} #w", "#w #w. {secret #ak} #W", "#w #env: {secret #b64}.",
        "ssn {national_id #d3-#d2-#d4} #w", "#w {national_id #d3-#d2-#d4}. #w", "passport {national_id #pp} #w", "id_number {national_id #pp}, #w",
        "iban {bank_account #iban} #w", "#w {bank_account #iban}, #w", "account {bank_account #iban}.",
        "IBAN {bank_account #ib #d4 #d4 #d4 #d4 #d2} #w", "#w iban: {bank_account #ib #d4 #d4 #d4 #d4 #d4}. #w", "#w konto {bank_account #ib #d4 #d4 #d4 #d4 #d4 #d3}, #w", "#w {bank_account #ib #d4 #d4 #d4 #d4 #d2} #w",
        "call {local_phone (#d3) #d3-#d4} #w", "tel {local_phone #d3-#d3-#d4} #w", "#w {local_phone #d3-#d3-#d4}. #w", "phone {local_phone 0#d3 #d6} #w", "#w {local_phone (#d3) #d3-#d4}, #w",
        "password {secret #short} #w", "#w passwort {secret #Short}, #w", "the password #of {secret #short}. #w", "pwd {secret #Short} #w", "#w kennwort #of {secret #Short}", "passphrase {secret #short}", "#w {secret #cloud} #w", "key {secret #cloud}, #w", "#w #w {secret #cloud}.", "#w {secret #pre#b64} #w", "token #of {secret #pre#b64}.", "secret {secret #pre#pre#b64} #w",
        "ssn #of {national_id #d3 #d2 #d4} #w", "#w ssn {national_id #d3 #d2 #d4}. #w", "social security number #of {national_id #d3-#d2-#d4}", "social #w number {national_id #d3 #d2 #d4}, #w", "dni {national_id #d8#L} #w", "nif #of {national_id #L#d7#L}", "#w dni: {national_id #d8#L}.", "insee {national_id #d1 #d2 #d2 #d2 #d3 #d3 #d2} #w", "passport #of {national_id #pp} #w", "#w steuernummer {national_id #d2 #d3 #d3 #d3} #w", "passport number {national_id #pp}.",
        "konto {bank_account #acct} #w", "account #of {bank_account #acct} #w", "#w account number #of {bank_account #acct}.", "kontonummer {bank_account #acct}, #w", "cuenta: {bank_account #acct} #w", "compte #of {bank_account #acct}", "iban {bank_account #ib #bic #d4 #d4 #d4 #d2} #w", "konto {bank_account 0#acct} #w", "account number #of {bank_account 0#acct}, #w", "account {bank_account #d4 #d4 #d4} #w",
        "call {local_phone 0#d3 #d7} #w", "mobile: {local_phone 0#d3 #acct} #w", "#w {local_phone 0#d3 #acct} #w", "insee #of {national_id #d1 #d2 #d2 #d2 #d3 #d3 #d2}", "#w insee {national_id #d1 #d2 #d2 #d2 #d3 #d3 #d2} #w", "phone {local_phone 0#d2 #d4 #d4} #w", "#w phone number #of {local_phone 0#d2 #d4 #d4}. #w", "tel {local_phone 0#d4 #d6}, #w", "#w {local_phone 0#d1 #d2 #d2 #d2 #d2} #w", "téléphone : {local_phone 0#d1 #d2 #d2 #d2 #d2}", "#w #w {local_phone 0#d1 #d2 #d2 #d2 #d2}. #w", "call #w {local_phone 0#d1 #d2 #d2 #d2 #d2} #w", "téléphone {local_phone 0#d1 #d2 #d2 #d2 #d2}, #w", "ring {local_phone #d3-#d4} #w", "call {local_phone #d3-#d4}. #w", "dial {local_phone #d3-#d4}, #w", "mobile {local_phone 0#d4 #d6} #w", "mobile #of {local_phone 0#d4 #d3 #d3} #w", "teléfono {local_phone #first#d2 #d3 #d3} #w", "tel {local_phone #d3.#d3.#d4} #w", "#w {local_phone #d3.#d3.#d4} #w", "telefon {local_phone 0#d2/#d6} #w", "fax #of {local_phone 0#d3-#d6} #w", "call #w #of {local_phone 0#d3 #d6}", "phone {local_phone 0#acct} #w", "tel #of {local_phone 0#acct}, #w", "ring #w on {local_phone 0#d3 #d7}",
        "#W.!! #W.!! #W!! #ü.!! #w.!!", "#w. #w. #ü. #ü. #ü. #w.", "#W! #W #W #W #W. #W", "password #of #w #w", "#w password for #w in #year", "the key #of #n #w", "#w press key #L#n to #w", "account #n of #n #w", "account #of #w in #year", "phone #n #w #w", "call #n #w #w", "ring #w #w #n", "#w call #of #w", "#w #n #n #n #w", "#w #d2 #d2 #d2 #d2 #w", "#w #d3 #d3 #w", "#w #d1 #d1 #d1 #d1 #w", "#w #alt #w", "#w #W #alt, #w", "model #alt #w", "#w 0#d3 to 0#d3 #w", "#w 0.#d2 #w 0.#d1", "#w 0#d1:#d2 #w", "zip 0#d4 #w", "#w #d5 #w #d5 #w", "order #d6 #w", "#w #d7 #w #d8.", "#w #w #d3-#d4 #w", "#w #d6 #d4 #w", "call me in #year-#mm", "mobile phone in #year #w", "phone #w 0.#d1 #w", "#w social #w #n #w", "the token #w #n #w", "#w #W#n #w #W#d2 #w", "#w-#n #w #w#n #w", "#w #w#d2 #w", "passport of #w #n #w", "secret #w #n #w", "#w #n.#d2.#n #w", "#w 0#d1 #w 0#d1 #w",
        "#w #w #ü, #w #w. #W #w #ü #w #w", "#w #w #w, #ü #w; #w #w: #w", "#W!! #W!! #W!! #w!! #ü!!", "#w*** #w&&& #ü$$$ #w%%% #w### #w", "#w | #w | #ü | #w", "Version #n.#n. #w Apache License, Version 2.0. #w", "version 3 or (at your option) #w", "#w #w in #d4, #w", "#w $#n.#d2 #w #n% #w",
        "#w #year-#mm-#mm #w", "#w (#year-#mm-#mm), #w", "on #mm-#mm-#year #w", "#year-#year #w", "#w from #year-#year. #w", "#mm/#mm/#year #w #w", "#w #mm.#mm.#year #w", "#year-#mm-#mm #mm:#d2:#d2 #w", "#w #mm:#mm-#mm:#d2 #w", "pages #d3-#d3 of #w", "#w #d2-#d2 #w", "#d4 #d4 #d4 #w", "#w #d4 #w #d4 #w", "phone in #year, #w", "#w #n,#d3,#d3 #w", "isbn #d3-#n-#d2-#d6-#n #w", "#w #W-#d4 #w", "flight #W #d4 #w", "#w v#n.#n.#n-#n #w", "account #w #w in #year #w", "#w = #w + #n", "key #w #w token #w", "password #w #w", "#w 20#d2-0#d2 #w #n:#d2 #w", "#w x@#w.example.com #w", "#w #w.#d2@mail.example.com### #w", "#n.#n.#n.#n #w #w", "#w #card #w #card.", "+1 (#d3) 555-#d4 #w", "#w +49 (#d3) 555-#d4%%% #w", "#w #n,#d3 #w #n. #w", "account of #w phone #w", "http://#w.example.org/#w/#n #w", "#w-#w #w/#w #w_#w (#w) \"#w\" '#w'",
    ]
    names = "|".join(sorted(fill, key=len, reverse=True))
    out = []
    for _ in range(copies):
        for template in templates:
            text, spans, start, kind = "", [], 0, ""
            for piece in re.findall(rf"\{{\w+ |\}}|#(?:{names})|[^{{}}#]+|#", template):
                if piece[0] == "{" and len(piece) > 1:
                    start, kind = len(text), piece[1:-1]
                elif piece == "}":
                    spans.append((start, len(text), kind))
                elif piece[0] == "#" and piece[1:]:
                    text += fill[piece[1:]]()
                else:
                    text += piece
            out.append((text, spans))
    return out


def _shapes(words: pa.StringArray) -> np.ndarray:
    """One number per word that says all the field knows of it: packed small features."""
    points, bounds = characters(words)
    size = np.diff(bounds)
    if not len(points):
        return np.zeros((len(words), len(CELLS)), dtype=np.int64)
    start = bounds[:-1]
    ascii_kind = np.zeros(128, dtype=np.int64)
    for bit, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "-", ".,", "@", "\"'", "=:", "()", "/_", "+", "!#$%&*|")):
        for c in chars:
            ascii_kind[ord(c)] = 1 << bit
    low = np.minimum(points, 127)
    kind = np.where(points < 128, ascii_kind[low], np.where(letters()[points], 1, 1 << 12))
    mask = np.bitwise_or.reduceat(kind, start) * (size > 0)
    total = lambda x: np.add.reduceat(x.astype(np.int64), start) * (size > 0)
    digit = kind == 4
    n_digits, n_other = total(digit), total((kind > 4))
    letter = kind < 4
    hexes = digit | ((points >= 97) & (points <= 102)) | ((points >= 65) & (points <= 70))
    all_hex = (total(letter & ~hexes) == 0) & (n_digits > 0) & (total(letter) > 0)
    change = np.zeros(len(points), dtype=bool)
    change[1:] = digit[1:] != digit[:-1]
    change[start[size > 0]] = False
    bucket = np.searchsorted(LENGTHS, size - n_other)
    keyword = np.zeros(len(words), dtype=np.int64)
    plain = pc.replace_substring_regex(pc.utf8_lower(words), r'^["(]+|["):=.,]+$', "")
    for i, some in enumerate(KEYWORDS):
        keyword[pc.is_in(plain, pa.array(some)).to_numpy(zero_copy_only=False)] = i + 1
    head = np.where(size > 0, points[np.minimum(start, len(points) - 1)], 0)
    lead = np.select([head == 48, (head > 48) & (head < 58), head == 40, (head >= 65) & (head <= 90)], [1, 2, 3, 4], 0)
    return np.stack([mask, bucket, np.searchsorted(LENGTHS, n_digits) * (n_digits > 0) + (n_digits > 0), np.minimum(total(change), 6) * 2 + all_hex, keyword, lead], axis=1)


#: Cells of each shape column.
CELLS = (1 << 13, 16, 16, 16, 8, 8)


def _feature_numbers(shapes: np.ndarray) -> list[np.ndarray]:
    """Feature numbers by shape: single columns and four crosses."""
    mask, length, digits, mix, keyword, lead = shapes.T
    cross = [mask % 512 * 16 + length, digits * 16 + length, mix * 16 + length, digits * 8 + lead]
    return [x % c + o for x, c, o in zip([mask, length, digits, mix, keyword, lead, *cross], FEATURE_CELLS, np.cumsum((0, *FEATURE_CELLS[:-1])), strict=True)]


FEATURE_CELLS = (*CELLS, 1 << 13, 256, 256, 128)
N_FEATURES = sum(FEATURE_CELLS)
KEYWORD, DIGITS_LEAD = 4, 9
#: Words whose features a word has, as (places after it, which features): itself, both neighbours, and key words and digits further off.
SIDES = ((0, range(10)), (-1, range(10)), (1, range(10)), (-2, (KEYWORD, DIGITS_LEAD)), (2, (DIGITS_LEAD,)), (-3, (KEYWORD, DIGITS_LEAD)), (-4, (DIGITS_LEAD,)))
#: Places of a key word that make a feature together with the digits of the word that they announce.
ANNOUNCED = (-1, -2, -3)
N_ALL = len(SIDES) * N_FEATURES + len(ANNOUNCED) * 8 * 128


def _within(bounds: np.ndarray, place: int) -> np.ndarray:
    """Words that have one of their own text ``place`` words after them (before them, if negative)."""
    at = np.arange(bounds[-1])
    text = np.searchsorted(bounds, at, side="right")
    there = at + place
    return at[(there >= bounds[text - 1]) & (there < bounds[text])]


def _announced(numbers: list[np.ndarray], codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words that a key word announces from each place, and the number of the feature that it makes with their digits."""
    base = np.cumsum((0, *FEATURE_CELLS))
    key = (numbers[KEYWORD] - base[KEYWORD])[codes]
    for i, place in enumerate(ANNOUNCED):
        at = np.flatnonzero(key) - place
        text = np.searchsorted(bounds, at + place, side="right")
        at = at[at < bounds[text]]
        yield at, len(SIDES) * N_FEATURES + (i * 8 + key[at + place]) * 128 + numbers[DIGITS_LEAD][codes[at]] - base[DIGITS_LEAD]


@dataclass
class Field:
    """Weights of all features (N_ALL, labels) and transitions."""

    weights: np.ndarray
    transitions: np.ndarray


def fit(table: list[tuple[str, list[Span]]] | None = None) -> Field:
    """Train on ``(text, spans)`` rows, by default the small table."""
    table = labelled_table() if table is None else table
    codes, words, bounds = split(pa.array([t for t, _ in table], pa.string()))
    gold = np.zeros(len(codes), dtype=np.int64)
    for (text, spans), first in zip(table, bounds, strict=False):
        for i, m in enumerate(WORD.finditer(text)):
            for a, b, kind in spans:
                if kind in ADDED_KINDS and m.start() < b and m.end() > a:
                    gold[first + i] = 1 + ADDED_KINDS.index(kind)
    # each occurrence is a word of its own, as its features include its neighbours'
    shapes = _shapes(words)
    numbers = [x[codes] for x in _feature_numbers(shapes)]
    features, owner = [], []
    for side, (place, which) in enumerate(SIDES):
        own = _within(bounds, place)
        features += [numbers[i][own + place] + side * N_FEATURES for i in which]
        owner += [own] * len(which)
    for own, number in _announced(_feature_numbers(shapes), codes, bounds):
        features.append(number)
        owner.append(own)
    longest = int(np.diff(bounds).max(initial=1))
    seq = bounds[:-1, None] + np.arange(longest)
    seq = np.where(np.arange(longest) < np.diff(bounds)[:, None], seq, -1)
    labels = np.where(seq >= 0, gold[np.maximum(seq, 0)], 0)
    weights, transitions = crf.train(features, owner, N_ALL, seq, labels, 1 + len(ADDED_KINDS), rounds=ROUNDS, rate=0.2, decay=2e-5)
    return Field(weights.astype(np.float32), transitions)


def label_words(field: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and labels of the words inside spans, and the texts' bounds among the words."""
    codes, words, bounds = split(texts)
    numbers = _feature_numbers(_shapes(words))
    k = field.transitions.shape[0]
    emit = np.zeros((len(codes), k), dtype=np.float32)
    for side, (place, which) in enumerate(SIDES):
        table = np.zeros((len(words), k), dtype=np.float32)
        for i in which:
            table += field.weights[numbers[i] + side * N_FEATURES]
        own = _within(bounds, place)
        emit[own] += table[codes[own + place]]
    for own, number in _announced(numbers, codes, bounds):
        emit[own] += field.weights[number]
    at, cuts = crf.islands(emit, bounds, field.transitions, 0)
    label = crf.viterbi(emit[at], cuts, field.transitions) if len(at) else np.zeros(0, dtype=np.int64)
    return at[label > 0], label[label > 0], bounds


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without the marks around it, and without the name of a value and its sign before it; signs within the value stay."""
    named = NAMED.match(text, a, b)
    if named and named.end() < b and not NAMES.isdisjoint({named[1].lower(), *re.split(r"[_\d]+", named[1].lower())}):
        a = named.end()
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def find(field: Field, texts: pa.Array) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans and all spans of each text."""
    texts = pc.fill_null(texts, "")
    plain = texts.to_pylist()
    digits = pc.match_substring_regex(texts, "[0-9]").to_pylist()
    base = [base_spans(t, d) for t, d in zip(plain, digits, strict=True)]
    out = [(b, b) for b in base]
    at, label, bounds = label_words(field, texts)
    row = np.searchsorted(bounds, at, side="right") - 1
    for r in np.unique(row):
        text, here = plain[r], row == r
        wanted = dict(zip((at[here] - bounds[r]).tolist(), label[here].tolist(), strict=True))
        added: list[Span] = []
        last = -2
        for i, m in enumerate(WORD.finditer(text)):
            if i not in wanted:
                continue
            kind = ADDED_KINDS[wanted[i] - 1]
            if last == i - 1 and added and added[-1][2] == kind:
                added[-1] = (added[-1][0], m.end(), kind)
            else:
                added.append((m.start(), m.end(), kind))
            last = i
        added = [(*_trim(text, a, b), kind) for a, b, kind in added]
        # numbers and accounts have digits; only a secret may do without
        free = [s for s in added if (s[2] == "secret" or any(c.isdigit() for c in text[s[0] : s[1]])) and s[0] < s[1] and not any(s[0] < b and s[1] > a for a, b, _ in base[r])]
        out[r] = (base[r], sorted([*base[r], *free], key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _over_texts(docs: DataFrame, field: Field | None, columns: tuple[str, ...], made, shape: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(field or fit())
    given = docs.select(*columns, *([] if "text" in columns else ["text"]))
    kinds = dict(given.dtypes)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *made(part.column("text"), find(shared.value, part.column("text")))], names)

    names = [*columns, *[x.split()[0] for x in shape.split(", ")]]
    return bounded_batches(given).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], shape]))


def detect(docs: DataFrame, field: Field | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` with counts per pattern kind, the digest of the pattern spans and all spans as ``kind:start:end`` text."""

    def made(_, found):
        counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in BASE_KINDS]
        return [*counts, pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([_joined(every) for _, every in found], pa.string())]

    return _over_texts(docs, field, columns, made, ", ".join([f"n_{k} bigint" for k in BASE_KINDS]) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans are one, under the first one's kind."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, field: Field | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` with ``clean_text``: the text without personal data; null stays null."""

    def made(texts, found):
        return [pa.array([None if t is None else masked(t, every) for t, (_, every) in zip(texts.to_pylist(), found, strict=True)], pa.string())]

    return _over_texts(docs, field, columns, made, "clean_text string")
