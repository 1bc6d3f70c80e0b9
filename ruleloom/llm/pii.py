"""Personal data replaced by surrogates.

Entities (e-mail addresses, telephone and card numbers, IP addresses, national ids, IBANs, dates of birth, addresses of
streets, keys, tokens, passwords, names after a form of address or an introduction, or that start with a known given
name) get keyed, type-consistent replacements: the same entity gets the same one in every document, of the same length,
separators, letter case, script, gender and check digits. Names are replaced word by word, so that Mr Smith, Dr Smith and
Mr John Smith share a surname before and after. Numbers go through a keyed
permutation of their own space, so different ones stay different; the rest are drawn by a keyed hash. All surrogates of
the corpus are then checked: one that equals another surrogate or any real entity is drawn again, until none does. After
some redraws surrogates leave the exact form (longer, or of a wider block), so that a full space never stops a run.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import drop, kept, pieces, shaped, table, written

#: redrawn entities that may be broadcast; more are joined to the documents that hold them
BROADCAST_REDRAWN = 200_000
#: redraws in the entity's exact form; each one after them adds a character, a syllable or a wider block
EXACT = 8

# fixed values: forms of address by gender, keywords before secrets, prefixes of keys
TITLES = {"m": "Mr Mister Sir Herr Herrn Señor Monsieur Don".split(), "f": "Mrs Ms Miss Madam Frau Señora Señorita Madame Mademoiselle Mme Mlle Doña".split(), "n": "Dr Prof Mx".split()}
GIVEN = {"m": "James John Robert Paul Peter Thomas Martin Lukas Felix Jonas Pierre Louis Antoine Hugo Carlos Diego Javier Pablo".split(), "f": "Mary Anna Laura Emma Julia Sarah Clara Lena Marie Sophie Camille Alice Carmen Elena Isabel Lucía".split()}
GIVEN["n"] = GIVEN["m"] + GIVEN["f"]
SYLLABLES = {"LATIN": "ba be bi bo ca ce da de di do fa fe ga go ha he ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti to va ve wa zo".split(), "CYRILLIC": "ба бе бо ва ве да де ди за ка ко ла ле ли ма ми на не но па по ра ри са се та ти то фа ха".split(), "GREEK": "βα γα δα δε δι ζα θα κα κο λα λε λι μα μι να νε νο πα ρα ρι σα σε τα τι το φα χα".split()}
KEYWORD = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)[\"']?\s*$")
VALUE = re.compile(r"\s*([\"']?)([^\s\"'<>,;]{6,})")
PREFIXED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk-", "eyJ")
DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
DIGITS = re.compile(r"\d[\d .()\-]*")
IP = re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)")
CARD = re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
PHONE = re.compile(r"(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{2,4}[ .-]\d{2,4}(?:[ .-]\d{2,4})?(?!\d)|\+\d{8,14}(?!\d)")
CARD_GROUPS = frozenset([(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4)])
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
WORD = r"[^\W\d_][\w-]*(?:['’](?!s\b)[\w-]+)*"
TITLED = re.compile(r"\b(" + "|".join(sorted((t for v in TITLES.values() for t in v), key=lambda t: (-len(t), t))) + rf")\.? ({WORD})(?: ({WORD}))?")
INTRODUCED = re.compile(rf"(?i:\bmy name is|\bname ?:|\bsigned ?[,:]|\bsincerely ?,\s|\bich hei(?:ß|ss)e|\bje m['’]appelle|\bme llamo) ?({WORD})(?: ({WORD}))?")
KNOWN = re.compile(r"\b(" + "|".join(sorted(set(GIVEN["n"]))) + rf") ({WORD})")
GENDER = {t: g for g, v in TITLES.items() for t in v}
HEX = frozenset("0123456789abcdefABCDEF:")
BORN = re.compile(r"(?i:\bborn(?: on)?|\bdate of birth|\bd\.?o\.?b\b\.?|\bgeboren am|\bnée? le|\bfecha de nacimiento)[\s:]{1,3}(\d{4}-\d\d-\d\d|\d{1,2}([./-])\d{1,2}\2(?:\d{4}|\d\d))(?!\d)")
STREETS = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Boulevard Blvd Square".split()
STREET = re.compile(r"(?<![\w.])\d{1,5} (?:[A-Z][a-z'’]+ ){1,3}(?:" + "|".join(STREETS) + r")\b|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz) \d{1,4}[a-z]?\b|(?<![\w.])\d{1,4},? (?:rue|avenue|boulevard) (?:de la |du |des |de )?[A-ZÉÈ][\w'’-]+|\b(?:Calle|Avenida) [A-ZÁÉÍÓÚ][\w'’-]+,? \d{1,4}\b")
STAY = frozenset([*STREETS, "Calle", "Avenida"])
#: texts that stand in every match of a pattern, and how far before and after them it may reach
NEAR = (
    (TITLED, [t for v in TITLES.values() for t in v], 24, 400),
    (KNOWN, GIVEN["n"], 24, 400),
    (INTRODUCED, ["name is", "Name is", "NAME IS", "ame:", "AME:", "ame :", "AME :", "igned", "IGNED", "incerely", "INCERELY", "ch hei", "CH HEI", "appelle", "APPELLE", "e llamo", "E LLAMO"], 24, 400),
    (BORN, ["born", "Born", "BORN", "irth", "IRTH", "ob:", "OB:", "ob.", "OB.", "OB ", "ob ", ".b", ".B", "eboren am", "EBOREN AM", "né le", "Né le", "née le", "Née le", "acimiento", "ACIMIENTO"], 24, 40),
    (STREET, [*(f" {x}" for x in STREETS), "straße", "strasse", "weg ", "platz ", "rue ", "avenue ", "boulevard ", "Calle ", "Avenida "], 120, 120),
)


def luhn(digits: str) -> int:
    """Sum that is a multiple of 10 for a right card number."""
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)


def iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def digits_of(s: str) -> str:
    return re.sub(r"\D", "", s)


def card_rank(text: str, a: int, b: int, greedy: bool) -> int:
    """3 for a right card number in usual groups, 2 for one that may be, 1 for another run taken whole, else 0."""
    digits = digits_of(text[a:b])
    if luhn(digits) % 10 or not digits.strip("0"):
        return 0
    groups = tuple(map(len, re.findall(r"\d+", text[a:b])))
    if re.match("[3-6]|2[2-7]", digits):
        if groups in CARD_GROUPS or len(groups) == 1:
            return 3
        if min(groups[:-1]) >= 3 and len(set(re.findall(r"\D", text[a:b]))) == 1:
            return 2
    return int(greedy)


def phone_rank(text: str, a: int, b: int, greedy: bool) -> int:
    """3 with a sign or bracket, 2 for groups of 3, 3, 4, 1 for ten digits that stand apart or as a whole, else 0."""
    s = text[a:b]
    n = len(digits_of(s))
    if not 9 <= n <= 15 or s[0] not in "+(" and n != 10:
        return 0
    if s[0] in "+(":
        return 3
    if tuple(map(len, re.findall(r"\d+", s))) == (3, 3, 4):
        return 2
    inner = set(re.findall(r"\D", s))
    return int(greedy or len(inner) == 1 and (s[0] == "0" or text[a - 1 : a] not in inner and text[b : b + 1] not in inner))


def numbers(pattern: re.Pattern, rank: Callable[[str, int, int, bool], int], text: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, rank) of the numbers in text[a:b]. Where the longest match is no number or a doubtful one, later starts and
    shorter ends at the borders of its groups of digits are tried: the best in rank, then the first, then the longest."""
    while m := pattern.search(text, a, b):
        best = (rank(text, *m.span(), True), -m.start(), m.end())
        if best[0] < 3:
            for s in range(m.start(), m.end()):
                g = pattern.match(text, s, b)
                for e in range(g.end(), s, -1) if g else ():
                    if text[e - 1].isdecimal() and not text[e : e + 1].isdecimal() and (s, e) != m.span() and pattern.fullmatch(text, s, e):
                        best = max(best, (rank(text, s, e, False), -s, e))
        if best[0]:
            if -best[1] > m.start():
                yield from numbers(pattern, rank, text, a, -best[1])
            yield -best[1], best[2], best[0]
            a = best[2]
        else:
            a = m.end()


@lru_cache(1)
def anchors():
    """One automaton of all texts in NEAR; the patterns that hold each by number."""
    import ahocorasick

    held: dict[str, list[int]] = {}
    for k, (_, words, *_) in enumerate(NEAR):
        for w in words:
            held.setdefault(w, []).append(k)
    auto = ahocorasick.Automaton()
    for w, of in held.items():
        auto.add_word(w, (len(w), tuple(of)))
    auto.make_automaton()
    return auto


def near(text: str) -> Iterator[tuple[re.Pattern, re.Match]]:
    """Matches of the patterns in NEAR, each looked for only about the texts that it must hold."""
    done = [0] * len(NEAR)
    for end, (size, of) in anchors().iter(text):
        for k in of:
            pattern, _, back, ahead = NEAR[k]
            for m in pattern.finditer(text, max(done[k], end - size + 1 - back), min(len(text), end + 1 + ahead)):
                if m.start() > end:
                    break
                if m.end() > end - size + 1:
                    done[k] = m.end()
                    yield pattern, m


def proper(word: str) -> bool:
    return word[0].isupper() and not word.isupper()


def gender_of(given: str, otherwise: str) -> str:
    """By the known names, so that one name has one gender whatever stands before it."""
    return next((g for g in "mf" if given in GIVEN[g]), otherwise)


def v6(s: str) -> str | None:
    try:
        return str(ipaddress.IPv6Address(s))
    except ValueError:
        return None


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of all entities, in order, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        right = DOMAIN.match(text, at + 1)
        if right:
            start = at
            while start and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
                start -= 1
            while text[start] in ".%+-":
                start += 1
            if start < at:
                found.append((start, right.end(), "email", text[start : right.end()].lower()))
        at = text.find("@", at + 1)
    for p in PREFIXES:
        at = text.find(p)
        while at >= 0:
            if (at == 0 or not text[at - 1].isalnum()) and (m := PREFIXED.match(text, at)):
                found.append((at, m.end(), "secret", m[0]))
            at = text.find(p, at + 1)
    for mark in "=:":
        at = text.find(mark)
        while at >= 0:
            if KEYWORD.search(text, max(0, at - 24), at) and (m := VALUE.match(text, at + 1)) and (mark == "=" or m[1] or re.search(r"\d", m[2])) and any(c.isalpha() or c.isdigit() for c in m[2]):
                found.append((m.start(2), m.end(2), "secret", m[2]))
            at = text.find(mark, at + 1)
    for run in DIGITS.finditer(text):
        a, b = max(0, run.start() - 5), min(len(text), run.end() + 1)
        if run.end() - run.start() < 7:
            continue
        for m in IP.finditer(text, a, b):
            if not text[max(0, m.start() - 9) : m.start()].rstrip().endswith((" v", "ersion")):
                found.append((m.start(), m.end(), "ip", ".".join(str(int(x)) for x in m[0].split("."))))
        phones = list(numbers(PHONE, phone_rank, text, a, b))
        for s, e, sure in numbers(CARD, card_rank, text, a, b):
            if sure > 1 or not any(s <= x and y <= e and r > 1 for x, y, r in phones):
                found.append((s, e, "card", digits_of(text[s:e])))
        for m in SSN.finditer(text, a, b):
            if m[0][0] != "9" and m[0][:3] not in ("000", "666"):
                found.append((m.start(), m.end(), "ssn", m[0]))
        for s, e, _ in phones:
            digits, plus = digits_of(text[s:e]), text[s] == "+"
            found.append((s, e, "phone", digits[1:] if plus and digits[0] == "1" and len(digits) == 11 else ("+" if plus else "") + digits))
    if re.search(r"[A-Z]{2}\d\d", text):
        for m in IBAN.finditer(text):
            s = m[0].replace(" ", "")
            if 15 <= len(s) <= 34 and iban_rest(s) == 1:
                found.append((m.start(), m.end(), "iban", s))
    at = text.find(":")
    while at >= 0:
        a, b = at, at + 1
        while a and text[a - 1] in HEX:
            a -= 1
        while b < len(text) and text[b] in HEX:
            b += 1
        if 6 <= b - a <= 39 and not (a and (text[a - 1].isalnum() or text[a - 1] in "_.")) and not (b < len(text) and (text[b].isalnum() or text[b] == "_")):
            if sum(map(bool, text[a:b].split(":"))) > 2 and (v := v6(text[a:b])):
                found.append((a, b, "ipv6", v))
        at = text.find(":", b)
    for pattern, m in near(text):
        if pattern is BORN:
            found.append((m.start(1), m.end(1), "born", m[1]))
        elif pattern is STREET:
            found.append((m.start(), m.end(), "street", m[0]))
        elif pattern is TITLED:
            if proper(m[2]):
                two = m[3] and proper(m[3])
                if two:
                    found.append((m.start(2), m.end(2), "given-" + gender_of(m[2], GENDER[m[1]]), m[2]))
                k = 3 if two else 2
                found.append((m.start(k), m.end(k), "surname", m[k]))
        elif proper(m[1]) and (pattern is INTRODUCED or proper(m[2])):
            found.append((m.start(1), m.end(1), "given-" + gender_of(m[1], "n"), m[1]))
            if m[2] and proper(m[2]):
                found.append((m.start(2), m.end(2), "surname", m[2]))
    if len(found) < 2:
        return found
    found.sort(key=lambda e: (e[0], -e[1]))
    out = [found[0]]
    for e in found[1:]:
        if e[0] >= out[-1][1]:
            out.append(e)
        elif e[1] - e[0] > out[-1][1] - out[-1][0]:
            out[-1] = e
    return out


class Draw:
    """A keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, *of):
        self.key, self.of, self.n, self.pool = key, repr(of).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hmac.new(self.key, self.of + b"%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x * n >> 32


def permute(key: bytes, tweak: object, value: int, size: int) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network, walked until it lands inside."""
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for k in range(8):
            f = hashlib.blake2b(f"{tweak}|{k}|{b}".encode(), key=key, digest_size=16).digest()
            a, b = b, a ^ int.from_bytes(f, "big") & mask
        value = a << half | b
        if value < size:
            return value


def walked(key: bytes, tweak: object, digits: str, fits: Callable[[str], bool]) -> str:
    """The permutation of digit strings of this length, restricted to those that fit."""
    while True:
        digits = str(permute(key, (tweak, len(digits)), int(digits), 10 ** len(digits))).zfill(len(digits))
        if fits(digits):
            return digits


def letters_like(c: str) -> list[str]:
    return [x for x in map(chr, range(ord(c) & ~31, (ord(c) & ~31) + 32)) if x.isalpha() and x.isupper() == c.isupper()]


def longer(s: str, n: int) -> str:
    """s with n more characters like its last letter or digit."""
    return s + n * next((c for c in reversed(s) if c.isdigit() or c.isalpha() and len(letters_like(c)) > 1), "a") if n else s


def like(draw: Draw, s: str) -> str:
    """A text of the same shape: letters for letters of the same case and alphabet, digits for digits."""
    hexa = bool(re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", s)) and not s.isdigit()
    out = []
    for c in s:
        if hexa:
            out.append(("0123456789abcdef" if s.lower() == s else "0123456789ABCDEF")[draw.below(16)])
        elif c.isdigit():
            out.append(str(draw.below(10)))
        elif "a" <= c <= "z" or "A" <= c <= "Z":
            out.append(chr((97 if c >= "a" else 65) + draw.below(26)))
        elif c.isalpha():
            near = letters_like(c)
            out.append(near[draw.below(len(near))])
        else:
            out.append(c)
    return "".join(out)


def special_ip(v: int) -> int:
    """Class of an address: its private or reserved block, 0 for public ones."""
    for k, (net, bits) in enumerate([(10 << 24, 8), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16), (127 << 24, 8), (0, 8), (224 << 24, 3), (169 << 24 | 254 << 16, 16)], 1):
        if v >> (32 - bits) == net >> (32 - bits):
            return k
    return 0


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The replacement of a canonical form, in canonical form. From attempt EXACT on its space grows with each attempt."""
    draw, extra = Draw(key, kind, canon, attempt), max(0, attempt - EXACT + 1)
    tail = "".join(str(draw.below(10)) for _ in range(extra)) if kind in ("phone", "card", "ssn") else ""
    if kind == "phone":
        plus, digits = canon[:1] == "+", canon.lstrip("+")
        head = digits[:2] if plus else ""
        rest = digits[len(head) :]
        first = (lambda d: d[0] >= "2") if rest[0] >= "2" else (lambda d: d[0] < "2")
        return "+" * plus + head + walked(key, (kind, head, attempt), rest, first) + tail
    if kind == "card":
        body = canon[0] + walked(key, (kind, canon[0], attempt), canon[1:-1], lambda d: True) + tail
        return body + str(-luhn(body + "0") % 10)
    if kind == "ssn":
        d = walked(key, (kind, attempt), canon.replace("-", ""), lambda d: d[0] != "9" and d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000") if canon[4:6] != "00" and canon[7:] != "0000" else walked(key, (kind, "odd", attempt), canon.replace("-", ""), lambda d: d[0] != "9" and d[:3] not in ("000", "666") and (d[3:5] == "00" or d[5:] == "0000"))
        return f"{d[:3]}-{d[3:5]}-{d[5:]}{tail}"
    if kind == "ip":
        a, b, c, d = map(int, canon.split("."))
        v = a << 24 | b << 16 | c << 8 | d
        block = special_ip(v)
        if attempt >= 3 * EXACT:  # beyond IPv4: the block for documentation
            return "2001:db8:" + ":".join(f"{draw.below(1 << 16):x}" for _ in range(6))
        if extra:  # private addresses anywhere in 10/8, then all as public ones
            if block in (1, 2, 3) and attempt < 2 * EXACT:
                v = 10 << 24 | draw.below(1 << 24)
            else:
                while special_ip(v := draw.below(1 << 32)):
                    pass
            return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
        net = {0: 32, 1: 24, 2: 20, 3: 16, 4: 24, 5: 24, 6: 29, 7: 16}[block]  # free bits
        low = v & (1 << net) - 1
        while True:
            low = permute(key, (kind, block, attempt), low, 1 << net)
            w = v >> net << net | low
            if special_ip(w) == block:
                return ".".join(str(w >> s & 255) for s in (24, 16, 8, 0))
    if kind == "iban":
        body = like(draw, longer(canon[4:], extra))
        return canon[:2] + f"{98 - iban_rest(canon[:2] + '00' + body):02d}" + body
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        labels, of = domain.split("."), Draw(key, "domain", domain, attempt)
        return like(draw, longer(local, extra)) + "@" + ".".join([*(x if x == "example" else like(of, x) for x in labels[:-1]), labels[-1]])
    if kind == "secret":
        keep = next((p for p in PREFIXES if canon.startswith(p)), "")
        return keep + like(draw, longer(canon[len(keep) :], extra))
    if kind == "ipv6":
        groups = canon.split(":")
        special = groups[0][:2] in ("fc", "fd", "fe", "ff")
        digit = lambda k: "123456789abcdef"[draw.below(15)] if k == 0 else f"{draw.below(16):x}"
        return ":".join(g if k == 0 and special or not g else "".join(digit(j) for j in range(min(4, len(g) + extra))) for k, g in enumerate(groups))
    if kind == "born":
        return born(draw, canon, extra)
    if kind == "street":
        words = [w if w in STAY or not (w[0].isupper() or w[0].isdigit()) else new_street(draw, w, extra) for w in canon.split(" ")]
        return " ".join(words)
    letters = [c for c in canon if c.isalpha()]
    script = unicodedata.name(letters[0], "LATIN").split()[0]
    if script not in SYLLABLES:
        return like(draw, longer(canon, extra))
    known = GIVEN[kind[-1]] if kind != "surname" else ()
    if script == "LATIN" and known and attempt < 3:
        return known[draw.below(len(known))]
    end = {"given-m": "o", "given-f": "a"}.get(kind, "") if script == "LATIN" else ""
    return (syllables(draw, script, max(2 if end else 3, len(canon) // 2) + extra) + end).capitalize()


def syllables(draw: Draw, script: str, n: int) -> str:
    return "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(n))


def new_street(draw: Draw, word: str, extra: int) -> str:
    """Another number of as many digits, or another name that keeps the ending which says what it is."""
    if word[0].isdigit():
        return str(1 + draw.below(9)) + like(draw, word[1:])
    end = next((x for x in ("straße", "strasse", "weg", "platz") if word.endswith(x)), "")
    comma = "," * word.endswith(",")
    return (syllables(draw, "LATIN", max(2, (len(word) - len(end)) // 2) + extra) + end).capitalize() + comma


def born(draw: Draw, canon: str, extra: int) -> str:
    """Another date of the same form; in the end of one with more room."""
    day, month = f"{1 + draw.below(28):02d}", f"{1 + draw.below(12):02d}"
    if extra:
        return f"{1000 + draw.below(9000)}-{month}-{day}"
    parts = re.split(r"[./-]", canon)
    if len(parts[0]) == 4:
        return f"{min(2020, int(parts[0]) - 10 + draw.below(20))}-{month}-{day}"
    mark = canon[len(parts[0])]
    year = f"{int(parts[2]) - 10 + draw.below(20):04d}" if len(parts[2]) == 4 else f"{draw.below(100):02d}"
    return mark.join([day if len(parts[0]) == 2 else str(1 + draw.below(9)), month if len(parts[1]) == 2 else str(1 + draw.below(9)), year])


def dressed(kind: str, original: str, canon: str, new: str) -> str:
    """The surrogate in the form that the original had: separators and letter case."""
    if kind in ("phone", "card", "iban"):
        old, fresh = re.sub(r"[^0-9A-Za-z]", "", original), new.lstrip("+")
        it = iter(old[: len(old) - len(canon.lstrip("+"))] + fresh)
        return "".join([*(next(it) if c.isalnum() else c for c in original), *it])
    if kind == "email":
        return new.upper() if original.isupper() else "".join(n.upper() if o.isupper() else n for o, n in zip(original, new)) if not original.islower() and len(original) == len(new) else new
    return new


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int], cache: dict) -> tuple[str, list[str], int]:
    """The text with surrogates, the kinds of its entities in order, and how many are different."""
    out, last, kinds, seen = [], 0, [], set()
    for a, b, kind, canon in entities(text):
        new = cache.get((kind, canon))
        if new is None:
            if len(cache) > 100_000:
                cache.clear()
            new = cache[kind, canon] = surrogate(key, kind, canon, attempts.get((kind, canon), 0))
        out += [text[last:a], dressed(kind, text[a:b], canon, new)]
        last = b
        kinds.append(kind)
        seen.add((kind, canon))
    out.append(text[last:])
    return "".join(out), kinds, len(seen)


def lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            found = sorted({e[2:] for t in batch.column("text").to_pylist() if t for e in entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["kind", "canon"])


def drawer(key: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, *x) for x in zip(*(b.column(c).to_pylist() for c in ("kind", "canon", "attempt")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], [*b.schema.names, "new"])

    return run


def assign(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt, new) of every different entity, with no two equal surrogates and none that is real."""
    kinds = "kind string, canon string, attempt int"
    real = written(docs.select("text").mapInArrow(lister, "kind string, canon string").distinct(), "entities")
    told = written(real.withColumn("attempt", F.lit(0)).mapInArrow(drawer(key), f"{kinds}, new string"), "surrogates")
    family = F.when(F.col("kind").startswith("given") | (F.col("kind") == "surname"), "name").otherwise(F.col("kind")).alias("family")  # names are told apart whatever their kinds
    while True:  # each redraw widens the space in the end, so that the clashes run out
        named = told.select("*", family)
        twice = named.groupBy("family", "new").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "kind", "canon")).alias("first")).where("n > 1").select("family", "new", "first")
        taken = real.select(family, F.col("canon").alias("new"))
        clash = named.join(twice, ["family", "new"]).where("kind <> first.kind OR canon <> first.canon").select("kind", "canon").union(named.join(taken, ["family", "new"], "left_semi").select("kind", "canon")).distinct()
        clash = written(clash, "clashes")
        if clash.isEmpty():
            return told
        again = told.join(clash, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1).select("kind", "canon", "attempt").mapInArrow(drawer(key), f"{kinds}, new string")
        old, told = told, written(told.join(clash, ["kind", "canon"], "left_anti").unionByName(again), "surrogates")
        drop(old)
        drop(clash)


OUTPUTS = "text string, n_entities long, n_distinct long, kinds string"


def replacer(key: bytes, share) -> Callable:
    """The last column is the text, the one before it the redrawn entities if they are not shared; the others are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, cache = share.value if share else {}, {}
        for whole in batches:
            rest = whole.num_columns - (1 if share else 2)
            for batch in pieces(whole, whole.num_columns - 1):
                own = [None] * batch.num_rows if share else batch.columns[-2].to_pylist()
                texts, kinds, different = [], [], []
                for t, mine in zip(batch.columns[-1].to_pylist(), own):
                    some = {(r["kind"], r["canon"]): r["attempt"] for r in mine} if mine else common
                    new, k, n = replace(t, key, some, {} if mine else cache) if t else (t, [], 0)
                    texts.append(new)
                    kinds.append(k)
                    different.append(n)
                more = [pa.array(texts, pa.string()), pa.array([len(k) for k in kinds], pa.int64()), pa.array(different, pa.int64()), pa.array([",".join(sorted(set(k))) for k in kinds], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:rest], *more], [*batch.schema.names[:rest], "text", "n_entities", "n_distinct", "kinds"])

    return run


def pseudonymise(docs: DataFrame, key: bytes, keep: list[str], broadcast_redrawn: int = BROADCAST_REDRAWN) -> DataFrame:
    """`keep` columns, text with surrogates, n_entities, n_distinct, kinds (sorted, comma-joined) of each row of docs.

    Texts without entities stay as they are; null stays null; rows are taken one by one, so repeated rows and ties
    change nothing; kept columns named as an output are replaced, other columns are not read. The key decides all
    surrogates: who holds it can link, but not invert the hashed kinds. Entities that had to be redrawn (few: see
    `assign`) are broadcast up to `broadcast_redrawn`, else joined to the rows that hold them. The entities stand in the
    shared folder while the query runs.
    """
    told = assign(docs, key).where("attempt > 0").select("kind", "canon", "attempt")
    keep = kept(keep, OUTPUTS)
    schema = shaped(docs, keep, OUTPUTS)
    source = docs.select(*keep, F.col("text").alias("_text"))
    if told.limit(broadcast_redrawn + 1).count() <= broadcast_redrawn:
        share = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["canon"]): r["attempt"] for r in told.collect()})
        return source.mapInArrow(replacer(key, share), schema)

    @F.udf("array<struct<kind:string,canon:string>>")
    def of(text):
        return sorted({e[2:] for e in entities(text or "")})

    digest = F.sha2("_text", 256)
    held = source.select(digest.alias("_row"), F.explode(of("_text")).alias("e")).distinct().select("_row", "e.*")
    mine = held.join(told, ["kind", "canon"]).groupBy("_row").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("_redrawn"))
    joined = source.withColumn("_row", digest).join(mine, "_row", "left").select(*keep, "_redrawn", "_text")
    return joined.mapInArrow(replacer(key, None), schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), b"ruleloom surrogates", ["doc_id"])
