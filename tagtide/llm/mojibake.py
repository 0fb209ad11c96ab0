"""Text decoded with the wrong encoding: found, and put back by undoing the wrong step.

Text is looked at word by word, a word being a stretch of letters and non-ASCII characters with at least one of the
latter. A garbling cost counts what no writing has: control and replacement characters, symbols inside words,
scripts changing inside a word, capitals after small letters, letters no one alphabet holds together. A word is
repaired by a round trip: it is encoded in a legacy encoding it could have been misread as and strictly decoded in
one it could have been written in; the result is kept when the cost drops, and tried again for nested layers.
UTF-8 sequences misread one byte at a time are also searched inside words that hold real foreign letters.
Words repeat, so each worker remembers its verdicts up to a bound.
Words of any length are judged whole; a long one that this does not settle is judged in pieces too, cut where no
misread character is split.

A document is garbled when a word of it can be repaired, or when it holds characters that only wrong decoding
leaves behind: replacement characters, C1 controls. Its text is restored word by word; the pair of encodings that
explains most of a document is tried first for every word of it, so words that could be read in two ways follow
the rest of the document. ``whole`` tells whether nothing garbled remains.

Defined cases: null, empty and blank texts are no cases; a leading U+FEFF alone is none; entities, markup and
misread letters are left alone; lost characters (U+FFFD) stay as they are and make ``whole`` false; texts of any
length are read whole; repeated rows give repeated rows; an empty table gives no rows; other columns do not matter.

A restored text is examined again until nothing more is found, so texts garbled any number of times come back. Where
something strange is left, the text may have been written in an East Asian encoding, whose characters take ASCII bytes
too and cross the ends of words: its lines are then read again as a whole. ``whole`` is true only where no lost or
control character is left, nothing can be made less strange, after plain legacy encodings nothing strange is left at
all, and no other reading explains the garbled words as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT_WORDS = 200_000
#: Words longer than this that are not explained as a whole are judged in pieces of at most so many characters too.
LONGEST = 256
#: The longest character a cut may fall into: four bytes, misread three times.
LOOK = 36
#: How much the cost must drop.
DROP = 1.5

SINGLE = (
    "cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp1253", "koi8-r", "cp1254", "cp866",
    "iso8859-2", "iso8859-7", "iso8859-5", "iso8859-9", "cp852", "cp1257", "mac_cyrillic", "cp737", "cp857", "koi8-u",
)
DOUBLE = ("gb18030", "gbk", "big5", "cp949", "cp932", "euc_jp")
#: Legacy encodings in which text may have been written and then read as another.
WRITTEN = (
    "cp1252", "cp1251", "cp1250", "cp1253", "cp1254", "koi8-r", "cp437", "cp850", "cp866", "mac_roman", "iso8859-2",
    "iso8859-7", "cp852", "iso8859-5", "mac_cyrillic", "cp737", "cp857",
)
#: The same for Japanese; accepted only where kana result.
WRITTEN_EAST = ("cp932", "euc_jp")
#: Encodings of several bytes in which whole lines may have been written.
WRITTEN_WIDE = ("gb18030", "big5", "cp949", "cp932", "euc_jp")
#: Letters beyond ASCII of the languages that are written in the Latin alphabet.
ALPHABETS = {
    "fr": "àâæçéèêëîïôœùûüÿñ", "es": "áéíóúüñ", "de": "äöüßé", "pt": "áâãàçéêíóôõúü", "pl": "ąćęłńóśźż", "sv": "åäöéà",
    "is": "áðéíóúýþæö", "tr": "çğıİöşüâîû", "da": "æøåé", "it": "àèéìíîòóùú", "ro": "ăâîșțşţ", "cs": "áčďéěíňóřšťúůýž",
    "hu": "áéíóöőúüű", "nl": "éëïóöü", "hr": "čćđšž", "sk": "áäčďéíĺľňóôŕšťúýž", "fi": "åäöšž", "et": "äöõüšž",
    "lv": "āčēģīķļņšūž", "lt": "ąčęėįšųūž", "cy": "âêîôûŵŷ",
}
SOUND = [frozenset(a) | frozenset(a.upper()) for a in ALPHABETS.values()]
RUSSIAN = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
VOWELS = frozenset("аеёиоуыэюяАЕЁИОУЫЭЮЯ")
GREEK = frozenset("αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏΪΫ")

WORD = re.compile(
    "(?<![A-Za-z'\x80-\U0010ffff])[A-Za-z']*+[\x80-\U0010ffff][A-Za-z'\x80-\U0010ffff]*+"
)
#: After these steps a lone capital A with tilde is what was left of a letter whose second byte, a no-break space or a
#: soft hyphen, had turned into a space or vanished.
GAPS = {(w, r) for w in ("cp1252", "latin-1") for r in ("utf-8", "utf-8 inside")}
SIGNS = "\ufeff♪♫–—“”‘’„…€™•"
LINE = re.compile("[^\n]+")
LOST = "�"
APOSTROPHE = "’‘ʼ'"
QUOTES = frozenset("“”„«»‹›‚\"")
BREAKS = frozenset("–—…―-")
#: Symbols that stand next to words in clean text.
AFTER = frozenset("™®©°ªº")
BEFORE = frozenset("¿¡§¶#©°ºª")
EAST_MARKS = re.compile("[\u3000-\u3003\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff5e]")
HAN = re.compile("[\u3400-\u9fff\ue000-\uf8ff]")
LATIN, CYRILLIC, GREEK_SCRIPT, EAST, OTHER = "L", "C", "G", "E", "O"


@lru_cache(maxsize=1 << 16)
def kind(ch: str) -> tuple[str, str]:
    """(class, script): l small letter, u capital, o other letter, m mark, a apostrophe, q quote, b break, s symbol,
    x control or lost character, z space."""
    code = ord(ch)
    if ch in APOSTROPHE:
        return "a", ""
    if ch in QUOTES:
        return "q", ""
    if ch in BREAKS:
        return "b", ""
    if code in (0xFEFF, 0xFE0F, 0x200D) or 0x200B <= code <= 0x200F:
        return "z", ""
    if EAST_MARKS.match(ch):
        return "z", ""
    cat = unicodedata.category(ch)
    if ch == LOST or (cat == "Cc" and code > 127) or cat in ("Co", "Cn", "Cs"):
        return "x", ""
    if cat[0] == "Z":
        return "z", ""
    if cat[0] == "M":
        return "m", ""
    if cat[0] != "L" or ch in AFTER:
        return "s", ""
    if code < 0x250 or 0x1E00 <= code < 0x1F00 or 0xFF21 <= code <= 0xFF5A:
        script = LATIN
    elif 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        script = GREEK_SCRIPT
    elif 0x400 <= code < 0x530:
        script = CYRILLIC
    elif code >= 0x2E80:
        script = EAST
    else:
        script = OTHER
    return {"Ll": "l", "Lu": "u", "Lt": "u"}.get(cat, "o"), script


def _letters_cost(run: str) -> float:
    """Cost of an unbroken run of letters."""
    cost = 0.0
    kinds = [kind(c) for c in run]
    for i, ((c0, s0), (c1, s1), a, b) in enumerate(zip(kinds, kinds[1:], run, run[1:])):
        if s0 != s1 and s0 and s1:
            east = b if s1 == EAST else a
            cost += (2.0 if HAN.match(east) else 0.5) if EAST in (s0, s1) else 3.0
        elif c0 == "l" and c1 == "u" and b > "\x7f" and not (a == "l" and (not i or kinds[i - 1][0] == "u")):
            cost += 2.0
        elif c0 == "l" and c1 == "u" and a > "\x7f" and s0 != LATIN:
            cost += 2.0
    latin = [c for c, (_, s) in zip(run, kinds) if s == LATIN and c > "\x7f"]
    if latin:
        held = set(latin)
        if not any(held <= a for a in SOUND):
            cost += 2.0 + 0.5 * len(held)
        longest = now = 0
        for c in run:
            now = now + 1 if c > "\x7f" else 0
            longest = max(longest, now)
        if longest >= 4:
            cost += longest - 2.0
        caps = [c for (c, _), ch in zip(kinds, run) if ch <= "\x7f"]
        small = sum(1 for (c, _), ch in zip(kinds, run) if c == "l" and ch > "\x7f")
        if small and len(caps) >= 2 and all(c == "u" for c in caps):
            cost += 1.5 * small
    cyr = [c for c, (_, s) in zip(run, kinds) if s == CYRILLIC]
    if cyr:
        cost += sum(1.0 for c in cyr if c not in RUSSIAN)
        if len(cyr) >= 4:
            hard = streak = 0
            for c in cyr:
                streak = streak + 1 if c not in VOWELS else 0
                hard = max(hard, streak)
            if hard >= 5:
                cost += 1.0 * (hard - 4)
            soft = sum(1 for a, b in zip(cyr, cyr[1:]) if a in VOWELS and b in VOWELS)
            if soft >= 3:
                cost += 1.0 * (soft - 2)
        if cyr[0] in "ьъыЬЪЫ":
            cost += 1.5
    grk = [c for c, (_, s) in zip(run, kinds) if s == GREEK_SCRIPT]
    cost += sum(1.0 for c in grk if c not in GREEK)
    return cost


def cost(word: str) -> float:
    """The garbling cost of a word."""
    total, run = 0.0, []
    n = len(word)
    kinds = [kind(c) if c > "\x7f" or not c.isalpha() else ("u" if c < "a" else "l", LATIN) for c in word]
    letter = [k in "luo" for k, _ in kinds]
    for i, c in enumerate(word):
        k = kinds[i][0]
        if letter[i]:
            run.append(c)
            continue
        if run and k != "m":
            total += _letters_cost("".join(run))
            run = []
        left = i > 0 and letter[i - 1]
        right = i + 1 < n and letter[i + 1]
        if k in "sq" and (left or right):
            total += 0.05
        if i and word[i - 1] in "ÂÃ" and (c in AFTER or c == "\xa0" and (i < 2 or not letter[i - 2])):
            total += 2.0  # a sign of two bytes, read byte by byte
        if k == "m":
            total += 0.3 if i and letter[i - 1] else 1.0
        elif k == "x":
            total += 4.0
        elif k == "s":
            near = i > 0 and kinds[i - 1][0] in "sq" and word[i - 1] != c
            if left and right:
                total += 2.5
            elif left and c not in AFTER or right and c not in BEFORE:
                total += 1.5
            if near:
                total += 1.0
        elif k == "q":
            if left and right and kinds[i - 1][1] != EAST:
                total += 2.0
            elif left and c in "„‚‹" or right and c in "”›":
                total += 1.5
    if run:
        total += _letters_cost("".join(run))
    return total + 4.0 * len(_marks().findall(word))


@lru_cache(maxsize=1)
def _marks() -> re.Pattern:
    """Frequent signs of three UTF-8 bytes, the byte order mark among them, as they look when read byte by byte."""
    back = {n: {b: c for c, b in _tables(n).items()} for n in SINGLE}
    seen = {"".join(back[n].get(b, " ") for b in sign.encode()) for sign in SIGNS for n in SINGLE}
    return re.compile("|".join(re.escape(m) for m in sorted(seen) if " " not in m))


@lru_cache(maxsize=None)
def _tables(name: str) -> dict[str, int]:
    """Character to byte of a single-byte encoding; bytes it leaves open stand for themselves."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


def as_bytes(word: str, name: str) -> bytes | None:
    if name in DOUBLE:
        try:
            if name == "gbk":
                # bytes that made no pair were kept one by one
                return b"".join(bytes([ord(c)]) if c <= "\xff" else c.encode(name) for c in word)
            return word.encode(name)
        except UnicodeEncodeError:
            return None
    table = _tables(name)
    try:
        return bytes([table[c] for c in word])
    except KeyError:
        return None


@lru_cache(maxsize=None)
def _sequences(name: str) -> re.Pattern:
    """UTF-8 sequences of two to four bytes as they look when read in a single-byte encoding."""
    back = {b: c for c, b in _tables(name).items()}
    of = lambda a, b: "[" + "".join(re.escape(back[x]) for x in range(a, b) if x in back) + "]"
    tail = of(0x80, 0xC0)
    return re.compile(f"{of(0xF0, 0xF5)}{tail}{{3}}|{of(0xE0, 0xF0)}{tail}{{2}}|{of(0xC2, 0xE0)}{tail}")


def read_again(word: str, name: str) -> str:
    """The word with every UTF-8 sequence misread as the encoding put back."""
    table = _tables(name)

    def back(m: re.Match) -> str:
        try:
            return bytes([table[c] for c in m.group()]).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _sequences(name).sub(back, word)


Step = tuple[str, str]
Chain = tuple[Step, ...]


def apply(word: str, step: Step) -> str | None:
    """One round trip; None where it is impossible or changes nothing."""
    wrong, right = step
    if right == "utf-8 inside":
        made = read_again(word, wrong)
        return made if made != word else None
    data = as_bytes(word, wrong)
    if data is None:
        return None
    try:
        made = data.decode(right)
    except UnicodeDecodeError:
        return None
    return made if made != word and "\x00" not in made else None


#: Strict UTF-8 is tried first: random bytes hardly ever pass it. Plain legacy encodings accept almost anything.
TELLING: list[Step] = [(w, "utf-8") for w in SINGLE + DOUBLE] + [(w, "utf-8 inside") for w in SINGLE]
PLAIN: list[Step] = [(w, r) for r in WRITTEN + WRITTEN_EAST for w in SINGLE if w != r]
PLAIN_STEPS = frozenset(PLAIN)
ORDER = {step: i for i, step in enumerate(TELLING + PLAIN)}
KANA = re.compile("[\u3041-\u30fa]")

INSIDE = 4


def _steps(word: str, steps: list[Step]) -> dict[str, Step]:
    """Distinct results of the steps, each with the first step that gives it."""
    out: dict[str, Step] = {}
    for step in steps:
        if LOST in word and step[1] != "utf-8 inside":
            continue
        made = apply(word, step)
        if made is not None and (step[1] not in WRITTEN_EAST or KANA.search(made)):
            out.setdefault(made, step)
    return out


def layered(word: str, start: float) -> tuple[str, Chain, float] | None:
    """The cheapest text after any number of strict UTF-8 round trips, fewest first. All distinct texts that a round trip
    of the whole word gives on the way are followed, and of those given by sequences put right inside it the INSIDE
    cheapest: the others hold fewer of these sequences put right, and every trip searches all of them again. Every trip
    shortens the text, so there is an end."""
    beam: list[tuple[str, Chain]] = [(word, ())]
    best: tuple[str, Chain, float] | None = None
    seen = {word}
    while beam:
        made = [
            (cost(text), len(beam_steps), text, (*beam_steps, step))
            for held, beam_steps in beam
            for text, step in _steps(held, TELLING).items()
            if text not in seen
        ]
        made.sort(key=lambda m: m[0])
        if made and made[0][0] <= start - DROP and (best is None or made[0][0] < best[2]):
            best = (made[0][2], made[0][3], made[0][0])
            if best[2] < DROP:
                break
        beam, inside = [], 0
        for _, _, text, steps in made:
            partly = steps[-1][1] == "utf-8 inside"
            if text not in seen and not (partly and inside >= INSIDE):
                seen.add(text)
                beam.append((text, steps))
                inside += partly
    return best


def from_han(word: str) -> tuple[str, Chain, float] | None:
    """A word of Han characters, of which Japanese text lacks at least one, that spells a clean word of another
    script once its bytes are read as UTF-8."""
    if not HAN.search(word) or KANA.search(word):
        return None
    try:
        word.encode("cp932")
        return None
    except UnicodeEncodeError:
        pass
    for name in DOUBLE:
        made = apply(word, (name, "utf-8"))
        if made is not None and not HAN.search(made) and cost(made) < 0.5:
            return made, ((name, "utf-8"),), cost(made)
    return None


def _settled(word: str, chain: Chain, left: float) -> bool:
    """Little of a long word is left to explain, or next to nothing after strict UTF-8; or so many bytes passed strict
    UTF-8 that it was not by chance, however strange the text."""
    if chain and chain[0][1] == "utf-8" and chain[0][0] in SINGLE and sum(c > "\x7f" for c in word) >= 12:
        return True
    return left < DROP or bool(chain) and chain[0][1] == "utf-8" and left < len(word) / 50


def repaired(word: str) -> tuple[str, tuple[Chain, ...], float]:
    """(text, chains, cost left). Several chains explain the word equally well; the text is that of the first.
    There are none where nothing lowers the cost."""
    start = cost(word)
    found = layered(word, start) if start >= DROP else from_han(word)
    # what leaves much of a long word may be chance: other readings of the whole are compared
    if found is not None and (len(word) <= LONGEST or _settled(word, found[1], found[2])):
        return found[0], (found[1],), found[2]
    if start < DROP:
        return word, (), start
    near: list[tuple[float, str, Step]] = []
    least = (found[2] if found else start) - DROP
    enough = least
    for step in PLAIN:
        text = _plain(word, step)
        if text is not None and (now := cost(text)) <= least + 0.6:
            least = min(least, now)
            near = [m for m in near if m[0] <= least + 0.6] + [(now, text, step)]
    if not near or (first := min(near, key=lambda m: m[0]))[0] > enough:
        return (found[0], (found[1],), found[2]) if found else (word, (), start)
    return first[1], tuple((m[2],) for m in near), first[0]


def _plain(word: str, step: Step) -> str | None:
    if LOST in word:
        return None
    made = apply(word, step)
    return made if made is not None and (step[1] not in WRITTEN_EAST or KANA.search(made)) else None


class Verdicts(dict):
    """Words met so far: (text, chains, cost left, garbled)."""

    def __missing__(self, word: str):
        text, chains, left = repaired(word)
        garbled = bool(chains) or any(kind(c)[0] == "x" for c in word)
        made = (text, chains, left, garbled)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = made
        return made


#: Encodings that put other letters at the same places: misread, words stay words, of another language.
FAMILY = ("cp1252", "cp1254", "cp1250")
LANGUAGES = tuple(ALPHABETS)


@lru_cache(maxsize=1 << 16)
def _beyond(word: str) -> frozenset[str]:
    """The Latin letters beyond ASCII of a word."""
    return frozenset(c for c in word if c > "\x7f" and kind(c)[1] == LATIN)


@lru_cache(maxsize=1 << 14)
def _sibling(strange: frozenset[str], language: str) -> Step | None:
    """The round trip within FAMILY that turns two or more of the letters into letters of the language."""
    own = SOUND[LANGUAGES.index(language)]
    best: tuple[int, Step] | None = None
    for wrong in FAMILY:
        for right in FAMILY:
            back = {c: apply(c, (wrong, right)) for c in strange} if wrong != right else {}
            hits = {c.lower() for c, made in back.items() if made in own and made > "\x7f" and kind(made)[0] == kind(c)[0]}
            if len(hits) >= 2 and (best is None or len(hits) > best[0]):
                best = len(hits), (wrong, right)
    return best[1] if best else None


def of_another_language(words: list[str]) -> tuple[Step, list[str]] | None:
    """The words of a document that are sound by themselves but hold letters its language lacks, where one misreading
    among related encodings explains two or more of these letters in three or more words; and that step."""
    letters = {w: held for w in words if len(w) > 2 and (held := _beyond(w))}
    if len(letters) < 4:
        return None
    sets = Counter(letters.values()).items()
    fit = [sum(n for held, n in sets if held <= a) for a in SOUND]
    top = max(range(len(fit)), key=fit.__getitem__)
    odd = {w: held - SOUND[top] for w, held in letters.items() if not held <= SOUND[top]}
    if len(odd) < 2 or fit[top] < len(odd):
        return None
    step = _sibling(frozenset().union(*odd.values()), LANGUAGES[top])
    if step is None:
        return None
    made = {w: apply(w, step) for w in odd}
    hit = [w for w, text in made.items() if text is not None and _beyond(text) <= SOUND[top] and cost(text) < 0.5]
    return (step, hit) if len({w.lower() for w in hit}) >= 3 else None


def _through(word: str, steps: Chain) -> str | None:
    made: str | None = word
    for step in steps:
        made = apply(made, step) if made is not None else None
    return made


def _explaining(votes: Counter, words: list[str]) -> tuple[Chain, bool]:
    """Of the proposed chains the one that leaves the least cost over all garbled words of a document, and whether
    another that reads some word differently leaves as little. Of plain readings that hardly differ the one of the more
    usual encoding is taken. Chains are dropped as soon as they cost more than the best so far."""
    slack = 0.06 * len(words)
    costs = {w: cost(w) for w in words}
    place = lambda steps: [ORDER.get(s, len(ORDER)) for s in steps]
    near: list[tuple[float, Chain]] = []
    least = float("inf")
    for steps, _ in sorted(votes.items(), key=lambda v: (-v[1], place(v[0]))):
        total = 0.0
        for w in words:
            made = _through(w, steps)
            total += costs[w] if made is None else min(costs[w], cost(made))
            if total > least + slack:
                break
        else:
            least = min(least, total)
            near.append((total, steps))
    near = [m for m in near if m[0] <= least + slack]
    if not near:
        return (), False
    telling = [m for m in near if m[1][0] not in PLAIN_STEPS and m[0] <= least + 1e-9]
    best = telling[0][1] if telling else min(near, key=lambda m: place(m[1]))[1]
    reads = lambda steps: [_through(w, steps) or w for w in words]
    own = reads(best)
    return best, any(reads(steps) != own for _, steps in near if steps != best)


def _cut(word: str, at: int, chain: Chain) -> int:
    """The end of the piece that begins at ``at``, at most LONGEST further on: the last place that no misread character
    straddles. Round trips that cannot be searched inside a word show it by passing, the others by giving on both
    sides of the cut together what they give without it."""
    end = at + LONGEST

    def passed(steps: Chain, look: int) -> int | None:
        for cut in range(end, end - look, -1):
            made = _through(word[at:cut], steps)
            if made is not None and (steps[-1][1] not in WRITTEN_EAST or KANA.search(made)):
                return cut
        return None

    for steps, look in ([(chain, LOOK)] if chain else []) + [(((w, "utf-8"),), 8) for w in DOUBLE]:
        if steps[0][1] != "utf-8 inside" and (cut := passed(steps, look)) is not None:
            return cut
    start = max(at, end - 2 * LOOK)
    around = word[start : end + 2 * LOOK]
    found = layered(around, now) if (now := cost(around)) >= DROP else None
    for steps in (chain, found[1] if found else ()):
        target = _through(around, steps)
        if target in (None, around):
            continue
        for cut in range(end, end - LOOK, -1):
            sides = _through(word[start:cut], steps) or word[start:cut], _through(around[cut - start :], steps) or around[cut - start :]
            if "".join(sides) == target:
                return cut
    for step in PLAIN:
        if step[1] in WRITTEN_EAST and (cut := passed((step,), 4)) is not None:
            return cut
    return end


def parts(word: str, whole: tuple, known: Verdicts) -> tuple[list[str], dict[str, tuple]] | None:
    """The pieces of a long word, cut at lost characters first, and their verdicts; None where it is best taken as a
    whole: it is settled, or no piece alone is repaired better."""
    chain = whole[1][0] if whole[1] else ()
    if len(word) <= LONGEST or _settled(word, chain, whole[2]):
        return None
    made, verdicts = [], {}
    for run in re.findall(f"{LOST}+|[^{LOST}]+", word):
        of_run = whole if run == word else known[run]
        own, at = of_run[1][0] if of_run[1] else (), 0
        if len(run) <= LONGEST or _settled(run, own, of_run[2]):
            made.append(run)
            verdicts[run] = of_run
            continue
        while at < len(run):
            end = _cut(run, at, own) if len(run) - at > LONGEST else len(run)
            made.append(run[at:end])
            at = end
    verdicts |= {p: known[p] for p in set(made) if p not in verdicts}
    gain = sum(max(0.0, cost(_through(p, chain) or p) - v[2]) for p, v in verdicts.items() if v[1])
    return (made, verdicts) if gain >= DROP else None


def strangeness(text: str) -> float:
    """The garbling cost of the distinct words of a text, lost characters aside."""
    words = {w for w in WORD.findall(text) if LOST not in w}
    return sum(c for w in words if (c := cost(w)) >= DROP)


@lru_cache(maxsize=None)
def _to_bytes(name: str) -> dict[int, int]:
    """Translation of a text to the bytes of a single-byte encoding; what it does not hold becomes unencodable."""
    table = {ord(c): b for c, b in _tables(name).items()}
    return table | {c: 0xFFFF for c in range(0x80, 0x100) if c not in table}


def read_wide(text: str, strange: float) -> tuple[str, str, bool] | None:
    """(text, step, unambiguous) where the lines of a text make more sense once their bytes are read in an encoding of
    several bytes. Lines that cannot be read so, or make less sense then, stay."""
    lines = text.split("\n")
    before = [sum(map(cost, set(WORD.findall(line)))) for line in lines]
    near: list[tuple[float, str, str]] = []
    for wrong in SINGLE:
        try:
            raw = [None if line.isascii() else _encoded(line, wrong) for line in lines]
        except UnicodeEncodeError:
            continue
        for right in WRITTEN_WIDE:
            made, total = list(lines), 0.0
            for i, data in enumerate(raw):
                now = before[i]
                if data is not None:
                    try:
                        other = data.decode(right)
                    except UnicodeDecodeError:
                        other = None
                    if other is not None and "\x00" not in other and (c := sum(map(cost, set(WORD.findall(other))))) <= now:
                        made[i], now = other, c
                total += now
                if total > strange / 4:
                    break
            else:
                near.append((total, "\n".join(made), f"{wrong}:{right}"))
    if not near:
        return None
    least = min(near, key=lambda m: m[0])
    if least[0] > strange - DROP or least[1] == text:
        return None
    return least[1], least[2], not any(m[0] <= least[0] + 0.6 and m[1] != least[1] for m in near)


def _encoded(line: str, wrong: str) -> bytes:
    return line.translate(_to_bytes(wrong)).encode("latin-1")


def examine(text: str | None, known: Verdicts) -> tuple[bool, str | None, bool, str | None]:
    """(garbled, restored text, whole, main steps) of one text."""
    found, made, whole, step = examined(text, known)
    if not found:
        return False, text, True, None
    seen = {text, made}
    while True:
        again, other, sound, further = examined(made, known)
        if not again or other in seen:
            break
        if not (_told(step) and _told(further)):
            # only strict UTF-8 is read again, and as nothing else; but what looks garbled still is not told whole
            whole = False
            break
        seen.add(other)
        made, whole, step = other, whole and sound, " > ".join(filter(None, (step, further)))
    left = strangeness(made)
    plain = step is not None and not _told(step)
    if plain or step is None:
        whole = whole and left < DROP
    if (plain or step is None and left >= DROP) and (wide := read_wide(text, strangeness(text))) is not None:
        now = strangeness(wide[0])
        # by chance bytes hardly ever make letters of an alphabet, but Han characters easily
        if now <= left - DROP or plain and now <= left and not any(kind(c)[1] == EAST for c in set(wide[0]) - set(text)):
            made, step, whole = wide[0], wide[1], wide[2] and now < DROP
    whole = whole and not any(kind(c)[0] == "x" for w in WORD.findall(made) for c in w)
    return True, made, whole, step


def _told(step: str | None) -> bool:
    """Whether a reading begins with strict UTF-8."""
    return step is not None and step.split(" > ")[0].endswith((":utf-8", ":utf-8 inside"))


def examined(text: str | None, known: Verdicts) -> tuple[bool, str | None, bool, str | None]:
    """The same after one look."""
    if not text or text.isascii():
        return False, text, True, None
    body = text[1:] if text[0] == "﻿" else text
    words = WORD.findall(body)
    verdicts = {w: known[w] for w in set(words)}
    pieces: dict[str, list[str]] = {}
    for w in [w for w in verdicts if len(w) > LONGEST]:
        if (cut := parts(w, verdicts[w], known)) is not None:
            pieces[w] = cut[0]
            del verdicts[w]
            verdicts |= cut[1]
    words = [p for w in words for p in pieces.get(w, (w,))]
    other_language = of_another_language([w for w, v in verdicts.items() if not v[3]])
    if other_language is not None:
        step, hit = other_language
        verdicts |= {w: (apply(w, step), ((step,),), 0.0, True) for w in hit}
    if not any(v[3] for v in verdicts.values()):
        return False, text, True, None
    votes: Counter = Counter()
    for w in words:
        for chain in verdicts[w][1]:
            votes[chain] += 1
    main, doubtful = _explaining(votes, [w for w in verdicts if verdicts[w][1]])
    whole = not doubtful

    @lru_cache(maxsize=None)
    def other(word: str) -> tuple[str | None, float]:
        made = _through(word, main) if main else None
        return made, 1e9 if made is None else cost(made)

    def sound(word: str) -> bool:
        """A word that the main step would spoil."""
        if verdicts[word][3] or not main:
            return False
        made, now = other(word)
        return as_bytes(word, main[0][0]) is None if made is None else now > cost(word) + 0.5

    mixed = any(sound(w) for w in verdicts)

    def line(m: re.Match) -> str:
        held = [p for w in WORD.findall(m.group()) for p in pieces.get(w, (w,))]
        follow = not mixed or (any(verdicts[w][3] for w in held) and not any(sound(w) for w in held))

        def restore(word: str) -> str:
            nonlocal whole
            made, chains, left, garbled = verdicts[word]
            if main and chains != (main,):
                text, now = other(word)
                if text is not None and (now <= left + 0.6 if garbled else follow and now <= cost(word)):
                    made = text
            if any(kind(c)[0] == "x" for c in made):
                whole = False
            return made

        whole_word = lambda w: "".join(map(restore, pieces.get(w.group(), (w.group(),))))
        return WORD.sub(whole_word, m.group()) if held else m.group()

    fixed = LINE.sub(line, body)
    if main and main[-1] in GAPS:
        fixed = re.sub("(?<![A-ZÀ-Þ])Ã ", "à", fixed)
        fixed = re.sub("(?<=[A-Za-zÀ-þ])Ã(?=[a-z])", "í", fixed)
    name = " > ".join(f"{w}:{r}" for w, r in main) or None
    return True, text[: len(text) - len(body)] + fixed, whole, name


def garbled_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, repaired, whole, step) of the garbled documents."""

    def look(batches):
        known = Verdicts()
        for batch in batches:
            keys, fixed, whole, steps = [], [], [], []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not value.is_valid:
                    continue
                found, made, all_of_it, step = examine(value.as_py().decode("utf-8", "replace"), known)
                if found:
                    keys.append(k)
                    fixed.append(made)
                    whole.append(all_of_it)
                    steps.append(step)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, batch.schema.field(0).type),
                    pa.array(fixed, pa.string()),
                    pa.array(whole, pa.bool_()),
                    pa.array(steps, pa.string()),
                ],
                [key, "repaired", "whole", "step"],
            )

    of = documents.schema[key].dataType.simpleString()
    rows = documents.select(key, F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(look, f"`{key}` {of}, repaired string, whole boolean, step string")
