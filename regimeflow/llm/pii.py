"""Problem 8: personal data in free text, by a semi-Markov conditional random field.

A text's labelling is a set of disjoint segments (start, end, kind) with ordinary text between them, which scores 0.
A segment scores the sum of the weights of its features, which look at the whole span (its written form, its parts'
likeness to given and family names, its length) and at its surroundings; two segments close together add the weights of
their kinds and of what stands between. The best labelling is found by dynamic programming over the candidate segments in
order of their ends, over the last segment, so weights of either sign are exact.
Candidates are spans of bounded length that have a form some kind can have; they may overlap and compete.

Three things are learned, from all rows: which written forms of numbers are of which kind (from the words that announce
them); how given and family names look (from the display names of mail headers, against the capitalised words of bodies);
and the weights (by maximum conditional likelihood, gradient ascent over forward-backward sums, on labels that rules give).
Forms and words are counted in one pass. In a second, candidates are found and kept, and each shard of some SHARD_ROWS rows,
by hash, climbs the likelihood of its texts; a feature's weight is the mean over all shards, so that one which few have, and
which can only repeat what the rules say of their rows, counts little. In a third the kept
candidates are labelled. The model, with the vocabulary of capitalised words, is broadcast; texts are labelled whole.
"""

from __future__ import annotations

import gc
import html
import html.entities
import marshal
import math
import re
import string
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from math import exp, log1p, sqrt
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import materialize, table

#: How often a word stands is taken for so many rows, if there are more.
TRAIN_ROWS = 3000
#: Of texts at hand so many train the weights, in so many rounds.
WEIGHT_ROWS, EPOCHS, RATE, DECAY = 400, 6, 0.3, 1e-3
#: Rows of a table that train weights together, in one round; a smaller table takes rounds until it has made so many steps.
SHARD_ROWS, STEPS = 3000, 2400
#: Characters that two segments may be apart to count as neighbours.
NEAR = 3
#: Order of candidates: by end, start and kind.
BY_END = itemgetter(1, 0, 2)
KINDS = ("email", "phone", "id_number", "address", "name")

# Written forms. SP is white space inside an entity: also no-break, coded, or a line break with the next
# line's quote marks; DASH a hyphen or en dash, also coded or wrongly decoded.
BREAK = r"(?:=|<br ?/?>)?\r?\n(?:(?:[>|»]|&gt;|&raquo;|=C2=BB|Â»)[ \t]?)*"
SP = rf"(?:{BREAK}|[    ]|&nbsp;|&#160;|=C2=A0|Â |=20)(?:[  ]|&nbsp;|=C2=A0|{BREAK})?"
NINES = str.maketrans("012345678", "9" * 9)
SHAPES = str.maketrans({**{str(i): "9" for i in range(10)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "A" for c in range(97, 123)}})
DASH = r"(?:-|–|‑|=E2=80=93|&ndash;|â€“|â\u0080\u0093)"
# letters of the Latin, Greek and Cyrillic scripts; Ã begins a wrongly decoded letter
LOWER = r"a-zß-öø-ÿ" + "".join(c for c in map(chr, range(0x100, 0x530)) if c.islower())
UPPER = r"A-ZÀ-ÂÄ-ÖØ-Þ" + "".join(c for c in map(chr, range(0x100, 0x530)) if c.isupper())
CODED = r"&[A-Za-z]+;|&#x?[0-9A-Fa-f]+;|=C3=[89AB][0-9A-F]|Ã[\u0080-¿Œ-™]"
REST = rf"(?:[{LOWER}{UPPER}'’\-]|{CODED})*"
WORD = rf"(?:[{UPPER}]|&[A-Z][a-z]+;|=C3=[89][0-9A-F]|Ã[\u0080-\u009fŒ-™]){REST}"
CODED_MARK = re.compile(r"[=&<\n]|  ")
SHAPE_SPACE, SHAPE_DASH = re.compile(SP), re.compile(DASH)
PARTICLES = ("van", "de", "von", "der", "den", "del", "di", "da", "af", "ten", "le", "la")
TITLES = ("mr", "ms", "mrs", "dr", "prof", "herr", "frau", "sr", "sra", "mme", "monsieur", "madame", "señor", "señora", "m")
EN_STREETS = r"(?:Street|Road|Avenue|Lane|Row|Court|Close|Drive|Way|Square|Terrace|Gardens|St\.|St|Rd|Ave|Ln|Ct)"
SHARP_S, E_ACUTE, U_UML = r"(?:ß|ss|&szlig;|=C3=9F|Ã\u009f|ÃŸ)", r"(?:é|e|&eacute;|=C3=A9|Ã©)", r"(?:ü|u|ue|&uuml;|=C3=BC|Ã¼)"
DE_ENDS = rf"(?:gasse|stra{SHARP_S}e|str\.|weg|platz|allee|damm|ufer|berg|br{U_UML}cke|ring|markt)"
FR_STREETS = rf"(?:[Rr]ue|[Aa]venue|[Aa]v\.|[Bb]oulevard|[Bb]d|[Cc]hemin|[Ii]mpasse|[Aa]ll{E_ACUTE}e|[Pp]lace|[Qq]uai|[Rr]oute|[Pp]assage|[Cc]ours)"
ES_STREETS = r"(?:[Cc]alle|C/|[Aa]vda\.|[Aa]venida|[Pp]aseo|[Pp]laza|[Cc]amino|[Rr]onda|[Tt]raves[ií]a|[Cc]arrera)"
NUMBER = r"\d{1,4}+(?:[a-z](?![a-z]))?"
ORDINAL = r"(?:n\.?(?:º|°|o|=C2=BA|=C2=B0|Âº|&ordm;)|n[ºo]|núm\.|N[rº]\.?)"
ADDRESSES = {
    "en": rf"{NUMBER}{SP}(?:{WORD}{SP}){{1,2}}?{EN_STREETS}(?![{LOWER}])",
    "fr": rf"{NUMBER}(?:{SP}(?:bis|ter|quater))?,?{SP}{FR_STREETS}(?:{SP}(?:de|du|des|la|le|les))*{SP}(?:(?:d|l)['’])?{WORD}",
    "es": rf"{ES_STREETS}(?:{SP}(?:de|del|la|las|los|el))*{SP}(?:{WORD}{SP}){{0,2}}?{WORD},?{SP}(?:{ORDINAL}{SP}?)?{NUMBER}",
}
MESSAGE_ID = re.compile(r"(?:[0-9a-f]{8}\.[0-9a-f]{6,}|00lost[0-9a-f]+)$")
AT = re.compile(r" @\r?\n| ?@ ?")
BRACKET_AT = re.compile(r"(?=[\s\[({])\s?[\[({] ?(?:at|AT) ?[\])}] ?")
SPELT_AT = re.compile(rf"(?=[\s=<&Â]){SP}(?:at|AT){SP}(?=[A-Za-z0-9\-]+{SP}(?:dot|DOT))")
ALNUM, INNER = string.ascii_letters + string.digits, "._%+-"  # of the part before @
LOCAL, BOX, NO_BOX = ALNUM + INNER, ALNUM + "._+", string.digits + "._+"
BOX_PARTS = re.compile(r"[._+\d]+")
DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
DOT = rf"(?:\.|{SP}(?:dot|DOT){SP}| ?[\[({{] ?(?:dot|DOT|\.) ?[\])}}] ?)"
SPELT = re.compile(rf"[A-Za-z0-9\-]+(?:{DOT}[A-Za-z0-9\-]+)*{DOT}[A-Za-z]{{2,}}")
SPELT_DOMAIN = re.compile(rf"[A-Za-z0-9\-]+(?:{SP}(?:dot|DOT){SP}[A-Za-z0-9\-]+)+")
EDGE = r"(?<![\w.,+/#=\-@])"
# A number of any kind: groups of figures, or of one or two capitals, with or without separators; a span of whole groups is
# a candidate. STARTS and LETTERS are where one may begin, as are addresses; what ends one is no letter, figure or slash.
SEPARATOR = rf"\)?(?:{SP}|{DASH}|[./])?\(?"
GROUP = r"(?:\d+|[A-Z]{1,2}(?![A-Za-z]))"
RUN = re.compile(rf"{EDGE}(?:\+|\(\+?)?{GROUP}(?:{SEPARATOR}{GROUP}){{0,9}}")
FIRST, NEXT = re.compile(rf"(?:\+|\(\+?)?{GROUP}"), re.compile(rf"{SEPARATOR}({GROUP})")
LAND = re.compile(r"\(?\+[1-9]|00[1-9]")
BEHIND = re.compile(r"(?![\w/]|[.\-]\d)")
# A short group of figures begins no number if what follows can't continue one, and no address if no word can follow. The last
# group of STARTS that took part is 1 where only a number may begin, 2 where an address may too, 3 where only an address may.
NO_GROUP = r"[a-z+:;\"'\]%*}!?_@#,.]|[A-Z](?:[a-z]|[A-Z][A-Za-z])"
NO_NUMBER = rf"[a-z+:;\"'\]%*|}}!?_@#,]|\Z|(?:[ ./\-]|\r?\n)(?:{NO_GROUP})"
MAY_NUMBER = rf"(?<![+#=].)(?:(?<=\d)|(?=\+?(?:\d|[A-Z]{{1,2}}(?![A-Za-z]))))(?!(?:(?<=\d)\d{{0,4}}+|(?<=[+(])\+?\d{{1,5}}+)(?:{NO_NUMBER}))"
MAY_PLACE = r"(?<=\d)(?=\d{0,3}+(?:[a-z](?![a-z]))?+,?+(?: [^\d+(:\-d-hj-osu-z]|[^\S ]|[=<&Â]))"
STARTS = re.compile(rf"[+(\d](?<![\w.,/@\-].)(?:{MAY_NUMBER}()(?:{MAY_PLACE}())?|{MAY_PLACE}())")
LETTERS = re.compile(rf"[A-Z](?![a-z])(?<![\w\-/].)(?=[A-Z]?(?:{SP}|{DASH})?\d)")
# what SP may begin with, besides white space
SPACES = ("=20", "=C2=A0", "&nbsp;", "&#160;", "Â\xa0", "<br", "=\n", "=\r")
# Figures that a number of each kind has, at least and at most.
FIGURES = {"phone": (7, 15), "id_number": (6, 16)}
FILL = r"(?:\W{1,3}(?:me|us|him|her|them|at|on|is|was|no|nr|number|nummer|num|número|numéro|n[º°]|unter|au|al|el|the|my|new))"
# Words that announce a number.
PHONE_WORDS = ("tel", "telephone", "telefon", "telefoon", "teléfono", "tél", "téléphone", "phone", "ph", "mobile", "mob", "mobil", "móvil", "portable", "handy", "cell", "fax", "telefax", "call", "ring", "dial", "whatsapp", "rufen", "llame", "appelez")
ID_WORDS = ("passport", "reisepass", "passeport", "pasaporte", "pass", "passnummer", "ausweis", "personalausweis", "licence", "license", "identity card", "identity", "national id", "id card", "personnummer", "dni", "nie", "nif", "ssn", "nino", "id number")
PHONE_CUE, ID_CUE = (re.compile(rf"(?i)(?<!\w)(?:{'|'.join(words)}){FILL}{{0,3}}\W{{1,4}}$") for words in (PHONE_WORDS, ID_WORDS))
CUE_TOKENS, TOKENS = frozenset(w.split()[0] for w in (*PHONE_WORDS, *ID_WORDS)), re.compile(r"\w+")
# the last token of such words and of FILL, where a degree sign is none; no more marks follow it
LAST_TOKENS = frozenset([*(w.split()[-1] for w in (*PHONE_WORDS, *ID_WORDS)), *re.findall(r"\w+", FILL.split("(?:")[2]), "n", "nº"])
LAST_TWO, NO_WORD = frozenset(w[-2:] for w in LAST_TOKENS), "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != "_")
LAST_TOKEN = re.compile(r"(?<!\w)(\w+)\W{1,5}$")
WEAK_ID_CUE = re.compile(r"(?i)\bid\W{1,3}$")
COUNTER_CUE = re.compile(r"(?:^|[^a-z])(?:step|epoch|pn|ref|job|lot|ticket|sha|version|node|run|t)(?:[ #=\r\n>|»]|<br>|&gt;)*$")
UNTOLD = dict.fromkeys((*FIGURES, "weak"), False)
#: A written form belongs to a kind if it was met so often, also for the number of rows, with so large a share right behind a
#: word that announces the kind.
SEEN, RARE, ANNOUNCED = 3, 1e-4, 0.05
ES_HINTS = ("alle", "C/", "vda.", "venida", "aseo", "laza", "amino", "onda", "raves", "arrera")
PLACES = re.compile(r"(?<![\w.,/@\-])(?:" + "|".join(f"(?P<{k}>{ADDRESSES[k]})" for k in ("en", "fr")) + ")")
PLACES_ES = re.compile(rf"\b{ADDRESSES['es']}")
DE_WORD = re.compile(rf"{DE_ENDS[:-1]}|str)$")
DE_BEFORE = re.compile(rf"(?<!\w)(?:Am|An{SP}der|An{SP}dem|Auf{SP}dem|Im|Zum|Zur|In{SP}der){SP}$")
DE_AFTER = re.compile(rf"\.?{SP}{NUMBER}(?!\d|[.:]\d)")
# WORD, but its first character is looked for before what stands in front of it
TOKEN = re.compile(rf"[{UPPER}&=Ã](?<![\w@.+\-=/&].)(?:(?<=[{UPPER}])|(?<=&)[A-Z][a-z]+;|(?<==)C3=[89][0-9A-F]|(?<=Ã)[\u0080-\u009fŒ-™])[{LOWER}{UPPER}'’\-]*+(?:(?:{CODED})[{LOWER}{UPPER}'’\-]*+)*+")
PREFIX = re.compile(rf"(?<!\w)(?:(?:{'|'.join(PARTICLES)}|VAN|DE|VON|DER|DEL){SP}){{1,3}}$")
# what can't stand last in it, and last but one before a space
NO_PREFIX = frozenset(string.printable) - set(string.whitespace + ";0>|B")
NO_PARTICLE = NO_PREFIX - set("".join(p[-1] + p[-1].upper() for p in PARTICLES))
INITIAL = re.compile(rf"(?<![\w.])[{UPPER}]\.{SP}$")
INITIAL_AFTER = re.compile(rf",{SP}[{UPPER}]\.")
GAP = re.compile(rf"(,?{SP})((?:(?:{'|'.join(PARTICLES)}|VAN|DE|VON|DER|DEL){SP}){{0,3}})")
# what no gap begins with, and what doesn't follow a space in one
NO_GAP = frozenset(".:;!?()[]{}\"'@|>/*_+-" + string.ascii_letters + string.digits)
NO_GAP_NEXT = frozenset(string.ascii_letters + string.digits) - set("".join(p[0] + p[0].upper() for p in PARTICLES))
LOW_FAMILY = re.compile(rf"{SP}(?:(?:{'|'.join(PARTICLES)}){SP}){{0,3}}((?:[{LOWER}'’\-]|{CODED})+)(?![\w@.+]*@)")
MARKS = " \t\r\n\xa0\"'<>(),.:;|»[]{}-–/\\"
HEADER = re.compile(r"(?i)\n(?:[>|»] ?)*(?:from|to|cc|von|an|de|para|reply-to)\s?:[ \t]*(.*(?:\r?\n[ \t].*)*)")
MAILBOX = re.compile(r"([A-Za-z][A-Za-z0-9._+]*)@")
DISPLAY = re.compile(r"(?:^|[,;]\s*)(\"[^\"]{3,60}\"|[^<>\"@,;:()]{3,60}?)\s*<[^<>\s]*@|@[\w.\-]+ \(([^()@]{3,60})\)")


class Model(NamedTuple):
    """names: log odds of a token's parts to be of a given or a family name; given: given names seen; weights: of segment
    features; shapes: written forms of numbers and the kind they belong to."""

    names: dict[str, tuple[float, float]]
    given: tuple[str, ...]
    weights: dict[str, float]
    shapes: dict[str, str] = {}


def shape_of(number: str) -> str:
    """Written form of a number: 9 for figures, A for letters, plain spaces and hyphens; a check character at the end, behind
    a hyphen, is 9 whether it's a figure or a letter."""
    if not number.isascii() or CODED_MARK.search(number):
        number = SHAPE_SPACE.sub(" ", SHAPE_DASH.sub("-", number))
    shape = number.translate(SHAPES)
    return shape[:-1] + "9" if shape.endswith("-A") else shape


#: Spans of the runs met last, relative to the run's start.
RUNS: dict[tuple[str, int], list[tuple[int, str, int]]] = {}


def run_at(text: str, p: int) -> tuple[str, int] | None:
    """The run of groups that begins at p, with the two characters behind it (no end is told by more), all figures as 9, and its
    length. All that is asked of runs but a country's code is the same for runs that agree in this."""
    m = RUN.match(text, p)
    if not m:
        return None
    end = m.end()
    if end - p < 6:  # as many figures as any kind has
        return None
    run = text[p : end + 2]
    return run if "=" in run or "&" in run else run.translate(NINES), end - p  # figures of coded signs stay


def spans_of(run: tuple[str, int]) -> list[tuple[int, str, int]]:
    spans = RUNS.get(run)
    if spans is None:
        if len(RUNS) > 100_000:
            RUNS.clear()
        spans = RUNS[run] = _numbers_of(*run)
    return spans


def numbers_at(text: str, p: int) -> list[tuple[int, str, int]]:
    """(end, shape, figures) of the spans of whole groups that begin at p and may be a number, the longest last."""
    run = run_at(text, p)
    return [(p + end, shape, figures) for end, shape, figures in spans_of(run)] if run else []


def _numbers_of(run: str, length: int) -> list[tuple[int, str, int]]:
    if sum(map(str.isdigit, run[:length])) < 6:
        return []
    out, figures, g = [], 0, FIRST.match(run)
    first = g[0].lstrip("(+")
    figures = len(first) if first[0].isdigit() else 0
    while g and figures <= 16:
        end = g.end()
        # two capitals behind a space are a word of their own
        if figures >= 6 and BEHIND.match(run, end) and not (g.re is NEXT and len(g[1]) == 2 and g[1].isalpha() and len(g[0]) > 2):
            shape = shape_of(run[:end])
            if shape.count("(") == shape.count(")"):
                out.append((end, shape, figures))
        g = NEXT.match(run, end) if end < length else None
        figures += len(g[1]) if g and g[1][0].isdigit() else 0
    return out


def announced(before: str) -> tuple[bool, bool]:
    """Whether the words right before a number announce a telephone number, and an id."""
    last = LAST_TOKEN.search(before, max(0, len(before) - 24))
    if not last or last[1].lower() not in LAST_TOKENS or CUE_TOKENS.isdisjoint(TOKENS.findall(before.lower())):  # as for most numbers
        return False, False
    return PHONE_CUE.search(before) is not None, ID_CUE.search(before) is not None


def told_before(text: str, p: int) -> bool:
    """Whether words right before p may announce a number; if not, announced() finds none, nor does WEAK_ID_CUE."""
    word = text[max(0, p - 12) : p].rstrip(NO_WORD)[-2:]
    return not word or word.lower() in LAST_TWO or not word[-1].isalnum() or not word[0].isalnum()


#: Per character of the basic plane (others as its last one): 1 if STARTS may begin with it, 2 if nothing of STARTS stands behind it,
#: 4 and 8 the same for LETTERS, 16 if it may stand second in LETTERS.
def _signs() -> np.ndarray:
    every = [*map(chr, range(65535))]
    of = lambda f: np.fromiter(map(f, every), np.uint8, 65535)
    alnum, figure, among = of(str.isalnum), of(str.isdecimal), lambda marks: of(marks.__contains__)
    letter = among(string.ascii_uppercase)
    signs = (figure | among("+(")) + 2 * (alnum | among("_.,/@-")) + 4 * letter + 8 * (alnum | among("_-/")) + 16 * (letter | figure | of(str.isspace) | among("=<&-") | (np.arange(65535) > 127))
    return np.append(signs, 1 + 4 + 16).astype(np.uint8)


SIGNS = _signs()
#: Characters of texts that are looked through at once.
AT_ONCE = 300_000


def begins(texts: list[str]) -> Iterator[tuple[list[tuple[int, int]], list[int]]]:
    """Per text where STARTS match, with the last group that took part, and where LETTERS do. Characters of many texts are looked
    through at once, the patterns only tried where their first characters fit."""
    group, n = [], 0
    for i, text in enumerate(texts):
        group.append(text)
        n += len(text)
        if n > AT_ONCE or i == len(texts) - 1:
            yield from _begins(group)
            group, n = [], 0


def _begins(texts: list[str]) -> Iterator[tuple[list[tuple[int, int]], list[int]]]:
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = SIGNS[np.minimum(codes, 65535)]
    behind, here, next_ = signs[:-2], signs[1:-1], signs[2:]
    starts = np.flatnonzero((here & 1) > (behind & 2))
    letters = np.flatnonzero(((here & 4) > (behind & 8)) & (next_ > 15))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = zip(np.searchsorted(starts, ends).tolist(), np.searchsorted(letters, ends).tolist())
    starts, letters = starts.tolist(), letters.tolist()
    i = j = at = 0
    for text, (i2, j2) in zip(texts, cuts):
        yield [(x - at, m.lastindex) for x in starts[i:i2] if (m := STARTS.match(text, x - at))], [x - at for x in letters[j:j2] if LETTERS.match(text, x - at)]
        i, j, at = i2, j2, at + len(text) + 1


def count_shapes(text: str, counts: dict[str, list[int]], begun: tuple[list, list] | None = None) -> None:
    """Add a text's numbers to the counts per written form: how often it stands, and how often right behind a word that
    announces a telephone number, or an id. A number is the longest span on one line. `begun`: what begins() says of the text."""
    starts, letters = begun or next(begins([text]))
    for places in ([p for p, last in starts if last < 3], letters):
        behind = 0
        for p in places:
            if p < behind:
                continue
            run = run_at(text, p)
            spans = spans_of(run) if run else None
            if not spans:
                continue
            end, shape, figures = spans[-1]
            if "\n" in run[0] and "\n" in text[p : p + end]:
                spans = [x for x in spans if "\n" not in run[0][: x[0]]]
                if not spans:
                    continue
                end, shape, figures = spans[-1]
            behind = p + end
            n = counts.get(shape)
            if n is None:
                n = counts[shape] = [0, 0, 0]
            n[0] += 1
            if told_before(text, p):
                for k, (kind, cue) in enumerate(zip(FIGURES, announced(text[max(0, p - 50) : p])), 1):
                    n[k] += FIGURES[kind][0] <= figures <= FIGURES[kind][1] and cue


def kind_of_shape(seen: int, phone: int, id_number: int, rows: int) -> str | None:
    """Kind that the counts of a form among so many rows tell, if any. No form is given beforehand."""
    kind, told = ("phone", phone) if phone >= id_number else ("id_number", id_number)
    return kind if seen >= max(SEEN, rows * RARE) and told > 1 and told >= ANNOUNCED * seen else None


def learn_shapes(texts: list[str]) -> dict[str, str]:
    """Written forms that words before them announce as telephone numbers or ids, of texts at hand."""
    counts: dict[str, list[int]] = {}
    for text in texts:
        count_shapes(text, counts)
    return {shape: kind for shape, n in counts.items() if (kind := kind_of_shape(*n, len(texts)))}


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles meanwhile: what texts and candidates make has none, but is much to look through again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def counted(documents: DataFrame) -> DataFrame:
    """(what, key, low, a, b, c) over all rows of `documents`: written forms of numbers with the counts of count_shapes; words
    with how often they are a given, a family name and any token, and their letters; parts of mail addresses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            any_word = Counter()
            for raw, n in tokens.items():
                any_word[plain(raw.rstrip("-'’"))] += n
            words = {*given, *family, *any_word}
            rows = [("shape", s, None, *n) for s, n in shapes.items()]
            rows += [("word", w, ascii_lower(w), given[w], family[w], any_word[w]) for w in words]
            rows += [("box", b, b, 0, 0, 0) for b in boxes]
            for x in (shapes, given, family, tokens, boxes):
                x.clear()
            types = [pa.string()] * 3 + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(types)], ["what", "key", "low", "a", "b", "c"])

        shapes: dict[str, list[int]] = {}
        given, family, tokens, boxes = Counter(), Counter(), Counter(), set()
        for batch in batches:
            with uncollected():
                rows = batch.column(0).to_pylist()
                for text, begun in zip(rows, begins(rows)):
                    count_shapes(text, shapes, begun)
                    count_words(text, given, family, tokens, boxes)
            if len(shapes) + len(tokens) + len(boxes) > 100_000:
                yield out()
        yield out()

    held = documents.filter("text IS NOT NULL").select("text").mapInArrow(run, "what string, key string, low string, a bigint, b bigint, c bigint")
    return held.groupBy("what", "key", "low").agg(*(F.sum(x).alias(x) for x in "abc"))


def shapes_of(counts: DataFrame, rows: int) -> dict[str, str]:
    """Known forms of so many rows, from counted(); the few that enough rows have (RARE bounds their number) come to the driver."""
    often = counts.filter((F.col("what") == "shape") & (F.col("a") >= max(SEEN, rows * RARE)) & (F.greatest("b", "c") >= F.greatest(F.lit(2), F.col("a") * ANNOUNCED)))
    return {x["key"]: kind for x in often.collect() if (kind := kind_of_shape(x.a, x.b, x.c, rows))}


def known_shapes(documents: DataFrame) -> dict[str, str]:
    """Written forms as learn_shapes, counted over all rows of `documents` where the texts are."""
    return shapes_of(counted(documents), documents.count())


def names_of(counts: DataFrame, rows: int) -> tuple[dict[str, tuple[float, float]], tuple[str, ...]]:
    """As learn_names, from counted(): all words that are a name in some header, or that no mail address has a part like."""
    words, boxes = counts.filter("what = 'word'"), counts.filter("what = 'box'").select("low").distinct()
    named = words.filter("a > 0 OR b > 0").select("key", "a", "b").collect()
    other = words.filter("a = 0 AND b = 0").join(boxes, "low", "left_anti").select("key", "c").collect()
    return weigh_names({x["key"]: x.a for x in named if x.a}, {x["key"]: x.b for x in named if x.b}, {x["key"]: x.c for x in other}, rows)


def plain(token: str) -> str:
    """A token with HTML, quoted-printable and wrong decoding undone, in title case if it is all capitals."""
    if "&" in token:
        token = html.unescape(token)
    if "=C3" in token:
        token = re.sub(r"=C3=([0-9A-F]{2})", lambda m: bytes([0xC3, int(m[1], 16)]).decode("utf-8", "replace"), token)
    if "Ã" in token:
        for code in ("cp1252", "latin-1"):
            try:
                token = token.encode(code).decode("utf-8")
                break
            except UnicodeError:
                continue
    return token.title() if len(token) > 3 and token.isupper() else token


def spellings(word: str) -> set[str]:
    """A word as it stands, in HTML, in quoted-printable and wrongly decoded."""
    coded = {word, "".join(f"={b:02X}" if b > 127 else chr(b) for b in word.encode())}
    coded.add("".join(f"&{html.entities.codepoint2name[ord(c)]};" if ord(c) in html.entities.codepoint2name and ord(c) > 127 else c for c in word))
    for code in ("cp1252", "latin-1"):
        try:
            coded.add(word.encode().decode(code))
        except UnicodeError:
            continue
    return coded


def ascii_lower(word: str) -> str:
    """Letters of a word as addresses spell them."""
    flat = unicodedata.normalize("NFKD", word.lower().replace("ø", "o").replace("ß", "ss"))
    return "".join(c for c in flat if c.isascii() and c.isalpha())


def token_parts(token: str) -> list[str]:
    t = token.replace("’", "'")
    core = t[2:] if t.startswith(("Mc", "O'")) and len(t) > 4 else t
    low = core.lower()
    return ["=" + t, "^" + low[:2], "^" + low[:3], "^" + low[:4], low[-2:] + "$", low[-3:] + "$", low[-4:] + "$", low[-5:] + "$", "#" + str(min(len(t), 14)), "m" if core is not t else "n"]


def header_names(text: str) -> Iterator[tuple[str, str]]:
    """(given, family) of the display names in a mail's headers."""
    for m in HEADER.finditer("\n" + text):
        for quoted, after in DISPLAY.findall(m[1]):
            if two := name_of(quoted or after):
                yield two


@lru_cache(20_000)
def name_of(shown: str) -> tuple[str, str] | None:
    """(given, family) of a display name, if it is of a person."""
    name = shown.strip('" \t\r\n')
    if name.count(",") == 1:
        family, given = (x.strip() for x in name.split(","))
    elif " " in name:
        given, family = name.split(" ", 1)
    else:
        return None
    if re.fullmatch(WORD, given) and re.fullmatch(rf"(?:[a-z]+ ){{0,3}}{WORD}", family):
        return plain(given), plain(family.split(" ")[-1])
    return None


def count_words(text: str, given: Counter, family: Counter, tokens: Counter, boxes: set[str]) -> None:
    """Add a text's names in headers, its capitalised words as they stand, and the parts of its mail addresses."""
    if "@" in text:
        for g, f in header_names(text):
            given[g] += 1
            family[f] += 1
        for box in {x[len(x.rstrip(BOX)) :].lstrip(NO_BOX).lower() for x in text.split("@")[:-1]}:
            if box:
                parts = BOX_PARTS.split(box)
                boxes.update(parts)
                boxes.update([p[:-1] for p in parts if len(p) > 5])  # a family name and an initial
    tokens.update(TOKEN.findall(text))


def learn_names(texts: list[str]) -> tuple[dict[str, tuple[float, float]], tuple[str, ...]]:
    """Log odds of token parts for given and family names, against capitalised words that no header and no address names; and the
    given names."""
    given, family, tokens, boxes = Counter(), Counter(), Counter(), set()
    for t in texts:
        count_words(t, given, family, tokens, boxes)
    other = Counter()
    for raw, n in tokens.items():
        w = plain(raw.rstrip("-'’"))
        if w not in given and w not in family and ascii_lower(w) not in boxes:
            other[w] += n
    return weigh_names(given, family, other, len(texts))


def weigh_names(given: dict[str, int], family: dict[str, int], other: dict[str, int], rows: int) -> tuple[dict[str, tuple[float, float]], tuple[str, ...]]:
    """The same from counts over so many rows, taken for TRAIN_ROWS rows if there are more, so that what is told doesn't drift with
    the size. Names that no header has are taken out of the words in a second round."""
    scale = min(1.0, TRAIN_ROWS / max(rows, 1))
    much = lambda n: 1 + math.log(n) if n >= 1 else n
    names: dict[str, tuple[float, float]] = {}
    for _ in range(2):
        counts = []
        for bag in (given, family, other):
            parts, total = Counter(), 0.0
            for token, seen in bag.items():
                if bag is other and names and token_score(token, names)[1] > 8:
                    continue
                n = seen * scale
                total += much(n)
                for p in token_parts(token):
                    parts[p] += max(n, 1.0) if p[0] == "=" else much(n)  # the word itself was met, however rare
            counts.append((parts, total))
        names = {}
        for p in set().union(*(c for c, _ in counts)):
            few = 0.05 if p[0] == "=" else 0.5
            per = [math.log((c[p] + few) / (n + 50)) for c, n in counts]
            names[p] = (per[0] - per[2], per[1] - per[2])
        # a word that bodies have again and again is one, however it looks
        names |= {"=" + t: (-30.0, -30.0) for t, n in other.items() if n * scale >= 3 and max(token_score(t, names)) < 5.5 or n * scale >= 25}
    first = tuple(sorted(g for g, n in given.items() if n > 1 and token_score(g, names)[0] > 4))
    return names, first


def token_score(token: str, names: dict[str, tuple[float, float]]) -> tuple[float, float]:
    g = f = 0.0
    for p in token_parts(token):
        w = names.get(p)
        if w:
            g, f = g + w[0], f + w[1]
    return g, f


def at_signs(text: str) -> Iterator[tuple[int, int]]:
    """Spans of AT in a text, from one sign to the next."""
    end, i = 0, text.find("@")
    while i >= 0:
        if i > end and text[i - 1] == " ":
            a, end = i - 1, AT.match(text, i - 1).end()
        else:
            a, end = i, i + 2 if text[i + 1 : i + 2] == " " else i + 1
        yield a, end
        i = text.find("@", end)


def places_es(text: str) -> Iterator[tuple[int, int]]:
    """Spans of PLACES_ES in a text, from what its street words hold."""
    starts = []
    for h in ES_HINTS:
        i = text.find(h)
        while i >= 0:
            starts.append(i - (h != "C/"))
            i = text.find(h, i + 1)
    end = 0
    for a in sorted(set(starts)):
        if a >= end and (m := PLACES_ES.match(text, a)):
            end = m.end()
            yield m.span()


class Labeller:
    """Candidates, features and the best labelling for one model; keeps what it found out about tokens."""

    def __init__(self, model: Model):
        self.model = model
        self.tokens: dict[str, tuple[str, int] | None] = {}
        self.scores: dict[tuple, float] = {}
        self.strings: dict[tuple | str, tuple[str, ...]] = {}
        self.held: dict[tuple, tuple[tuple[str, ...], str, tuple[bool, bool, bool]]] = {}
        low = {g.lower() for g in model.given}
        self.low = {v for g in low for v in spellings(g)}
        self.split = {v for v in self.low if v.split() != [v] or any(c in v for c in (">", *SPACES))}  # no single words below

    def token(self, raw: str) -> tuple[str, int] | None:
        """("G", "F" or in capitals "C", how sure) of a token that may be of a name, with "S" before if of a street; else None."""
        if raw in self.tokens:
            return self.tokens[raw]
        t = plain(raw)
        g, f = token_score(t, self.model.names)
        best = max(g, f)
        kind = "G" if g >= f else "C" if raw.isupper() else "F"
        found = (kind, min(int((best + 4) // 4), 5)) if best > (8 if kind == "G" else -3) and (len(t) > 2 or max(self.model.names.get("=" + t, (0.0, 0.0))) > 2) else None  # many words look like a given name; of two letters, only those that headers name
        if DE_WORD.search(t):
            found = ("S" + (found[0] if found else ""), found[1] if found else 0)
        if len(self.tokens) > 200_000:
            self.tokens.clear()
        self.tokens[raw] = found
        return found

    def candidates(self, text: str, bare: list | None = None, begun: tuple[list, list] | None = None) -> list[tuple[int, int, str, tuple]]:
        """(start, end, kind, form): spans that may be a segment, with what their features are made from. `bare` gets those of
        numbers as if no form were known; `begun` is what begins() says of the text."""
        out: list[tuple[int, int, str, tuple]] = []
        low = text.lower() if "AT" in text else text
        for a, b in at_signs(text):
            d = DOMAIN.match(text, b)
            if d:
                left = text[a - 66 if a > 66 else 0 : a]
                if left[-1:] in "\r\n":
                    left = left.removesuffix("\n").removesuffix("\r")  # a line may break before the sign
                end = (a - 66 if a > 66 else 0) + len(left)
                left = left[len(left.rstrip(LOCAL)) :].lstrip(INNER)
                if left and left[-1] not in INNER:
                    known = "msgid" if left[-1] in "0123456789abcdef" and ("." in left or "00lost" in left) and MESSAGE_ID.search(left) else "spaced" if b - a > 1 else "plain"
                    out.append((end - len(left), d.end(), "email", (known, "digits" if left.isdigit() else "")))
        for there, at, domain, form in (("[at" in low or "(at" in low or "{at" in low, BRACKET_AT, SPELT, "bracket"), (" dot" in low or "\ndot" in low, SPELT_AT, SPELT_DOMAIN, "words")):
            for a, b in (m.span() for m in at.finditer(text)) if there else ():
                d = domain.match(text, b)
                pre = text[max(0, a - 66) : a].removesuffix("\n").removesuffix("\r")  # a line may break before the sign
                left = pre[len(pre.rstrip(LOCAL)) :].lstrip(INNER)
                if d and left and left[-1] not in INNER:
                    known = "msgid" if MESSAGE_ID.search(left) else form
                    out.append((max(0, a - 66) + len(pre) - len(left), d.end(), "email", (known, "digits" if left.isdigit() else "")))
        place = 0  # end of the last address; the next begins behind it
        starts, letters = begun or next(begins([text]))
        for p, what in starts:
            if what < 3:
                self._numbers(text, p, out, bare)
            m = PLACES.match(text, p) if what > 1 and p >= place else None
            if m:
                out.append((*m.span(), "address", (m.lastgroup,)))
                place = m.end()
        for p in letters:
            self._numbers(text, p, out, bare)
        for a, b in places_es(text):
            out.append((a, b, "address", ("es",)))
        self._names(text, out)
        return out

    def _numbers(self, text: str, p: int, out: list, bare: list | None) -> None:
        """Candidates that begin at p: of a kind that their form belongs to, or that the words before announce; and telephone
        numbers with + or 00 before a country's code. A form that belongs to no kind is "rare"."""
        run = run_at(text, p)
        spans = spans_of(run) if run else None
        if not spans:
            return
        shapes = self.model.shapes
        land = text[p] in "+(0" and LAND.match(text, p) is not None
        cues, told = UNTOLD, land
        if told_before(text, p):
            before = text[max(0, p - 50) : p]
            cues = dict(zip(FIGURES, announced(before)), weak=WEAK_ID_CUE.search(before, max(0, len(before) - 6)) is not None)
            told = land or True in cues.values()
        if told or any([x[1] in shapes for x in spans]):
            self._told(text, p, spans, shapes, cues, land, out)
        if told and bare is not None:
            self._told(text, p, spans, {}, cues, land, bare)

    def _told(self, text: str, p: int, spans: list, shapes: dict[str, str], cues: dict[str, bool], land: bool, out: list) -> None:
        # the whole number is the longest span of a known form, else the longest on one line
        whole = ([x[0] for x in spans if x[1] in shapes] or [x[0] for x in spans if "\n" not in text[p : p + x[0]]] or [spans[-1][0]])[-1]
        for end, shape, figures in spans:
            known = shapes.get(shape)
            if known is None and not (land or cues["phone"] or cues["id_number"] or cues["weak"]):
                continue
            for kind, (least, most) in FIGURES.items():
                if known is not None and known != kind and not cues[kind] or not least <= figures <= most:
                    continue
                if known is None and not (cues[kind] or kind == "phone" and land or kind == "id_number" and cues["weak"]):
                    continue
                lead = text[p : p + 3] if text[p] == "+" else text[p]
                out.append((p, p + end, kind, (shape if known else "rare", known or "", "cue" if cues[kind] else "", "land" if land else "", "whole" if end == whole else "part", lead, figures)))

    def _names(self, text: str, out: list) -> None:
        last: tuple[int, int, str, int, int] | None = None  # start with particles, end, type, sureness, bare start
        known = self.tokens.get
        for m in TOKEN.finditer(text):
            t = known(m[0], m)
            if t is m:
                t = self.token(m[0])
            if t is None:
                continue
            a, b = m.span()
            while text[b - 1] in "-'’":
                b -= 1
            after = text[b : b + 1]
            if after and after not in " ,\n" and (after in "@_+/" or after.isalnum() or after == "." and text[b + 1 : b + 2].isalnum()):
                continue
            kind, sure = t
            if kind[0] == "S":
                n = DE_AFTER.match(text, b)
                if n:
                    p = DE_BEFORE.search(text, max(0, a - 12), a)
                    out.append((p.start() if p else a, n.end(), "address", ("de", "am" if p else "")))
                kind = kind[1:]
                if not kind:
                    continue
            start = a
            if kind != "G":
                none = a < 2 or text[a - 1] in NO_PREFIX or text[a - 1] == " " and text[a - 2] in NO_PARTICLE
                p = None if none else PREFIX.search(text, max(0, a - 24), a)
                if p:
                    start = p.start()
            if kind != "C":  # a word in capitals is a name only beside a given one
                out.append((start, b, "name", (kind, sure, sure)))
            if start != a and kind != "C":
                out.append((a, b, "name", ("bare", sure, sure)))
            if kind != "G":
                i = INITIAL.search(text, max(0, start - 6), start) if text.find(".", max(0, start - 6), start) >= 0 else None
                if i:
                    out.append((i.start(), b, "name", ("I F", sure, sure)))
                i = INITIAL_AFTER.match(text, b) if after == "," else None
                if i:
                    out.append((start, i.end(), "name", ("F, I", sure, sure)))
            if last and start >= last[1]:
                end = last[1]
                c = text[end]
                if c == " " and a == end + 1:  # as for most
                    g, comma = True, False
                elif c in NO_GAP or c == " " and text[end + 1] in NO_GAP_NEXT:
                    g = None
                elif g := GAP.fullmatch(text, end, a):
                    comma = g[1].startswith(",")
                    g = not (comma and g[2])
                if g:
                    low, high = (sure, last[3]) if sure < last[3] else (last[3], sure)
                    out.append((last[0], b, "name", (f"{last[2]}{',' if comma else ''} {kind}", low, high)))
            last = (start, b, kind, sure, a)
        words = text.replace(">", " ") if ">" in text else text
        if "=" in words or "&" in words or "<b" in words or "Â" in words:  # as all of them have
            for c in SPACES:
                if c in words:
                    words = words.replace(c, " ")
        for g in self.low.intersection(words.split()) | self.split:
            a = text.find(g)
            while a >= 0:
                m = LOW_FAMILY.match(text, a + len(g))
                if m and (a == 0 or text[a - 1] in " \n>\xa0"):
                    t = self.token(plain(m[1]).title())
                    if t and t[0][-1] in "FC":
                        out.append((a, m.end(), "name", ("g f", t[1], t[1])))
                a = text.find(g, a + 1)

    def features(self, key: tuple | str) -> tuple[str, ...]:
        """Strings of a segment's features; a key may be as code_of() writes it."""
        fs = self.strings.get(key)
        if fs is None:
            if len(self.strings) > 100_000:
                self.strings.clear()
            fs = self.strings[key] = self._strings(key_of(key) if isinstance(key, str) else key)
        return fs

    def _strings(self, key: tuple) -> tuple[str, ...]:
        kind, form, word, mark, after, length = key
        if kind == "name":
            who = "title" if word in TITLES else word
            return ("name", f"n:{form[0]}", f"n:{form[0]}:{form[1]}", f"n+:{form[2]}", f"nb:{who}", f"nm:{mark}", f"na:{after}", f"nl:{length}")
        if kind in FIGURES:
            shape, known, cue, land, whole, lead, figures = form
            return (kind, f"{kind}:{shape}", f"{kind}:{shape}:{lead}", f"{kind}:is:{known}", f"{kind}:{cue}", f"{kind}:{land}", f"{kind}:{whole}", f"{kind}:{cue}:{land}:{whole}:{'rare' if shape == 'rare' else ''}", f"{kind}#{figures}", f"{kind}<{word}", f"{kind}<{mark}", f"{kind}>{after}")
        return (kind, f"{kind}:{':'.join(form)}", f"{kind}<{word}", f"{kind}<{mark}", f"{kind}>{after}")

    def spans(self, text: str, begun: tuple[list, list] | None = None) -> list[tuple[int, int, str, tuple]]:
        """Candidates with what their features are made from, by end and start."""
        return self._by_end(text, self.candidates(text, None, begun))

    def both_spans(self, text: str, begun: tuple[list, list] | None = None) -> tuple[list, list]:
        """The same, and as if no form of numbers were known."""
        bare: list = []
        spans = self._by_end(text, self.candidates(text, bare, begun))
        others = [x for x in spans if x[2] not in FIGURES]
        return spans, sorted(others + self._by_end(text, bare), key=BY_END) if bare else others

    def _by_end(self, text: str, found: list) -> list[tuple[int, int, str, tuple]]:
        """Candidates with what their features are made from: kind and form, the word and marks before, what follows, length."""
        out = []
        left: dict[int, tuple[str, str]] = {}
        right: dict[int, str] = {}
        found.sort(key=BY_END)
        last: list[tuple] = [(-1, -1, "", ())]  # those of the same place and kind
        for c in found:
            a, b, kind, form = c
            if b == last[0][1] and a == last[0][0] and kind == last[0][2]:
                if c in last:
                    continue
                last.append(c)
            else:
                last = [c]
            before = left.get(a)
            if before is None:
                pre = text[a - 20 if a > 20 else 0 : a]
                bare = pre.rstrip(MARKS)
                mark = pre[len(bare) :]
                if "\r" in mark:
                    mark = mark.replace("\r", "")
                word = bare.rsplit(None, 1)[-1].lower()[-12:] if bare and not bare[-1].isspace() else ""
                before = left[a] = word, mark[-2:]
            after = right.get(b)
            if after is None:
                after = text[b : b + 1]
                if after == "\r":
                    after = text[b + 1 : b + 2].replace("\r", "")
                after = right[b] = "x" if after.isalpha() else "9" if after.isdigit() else after
            length = (b - a) // 8
            out.append((a, b, kind, (kind, form, *before, after, length if length < 5 else 5)))
        return out

    def entries(self, spans: list[tuple[int, int, str, tuple]]) -> list[tuple[tuple[str, ...], str, tuple[bool, bool, bool]]]:
        """Features, code and rule() of spans()."""
        get = self.held.get
        return [get(x[3]) or self._entry(x[3]) for x in spans]

    def _entry(self, key: tuple) -> tuple[tuple[str, ...], str, tuple[bool, bool, bool]]:
        if len(self.held) > 100_000:
            self.held.clear()
        fs = self._strings(key)
        found = self.held[key] = fs, code_of(key), rule(key[0], fs)
        return found

    def lattice(self, text: str) -> list[tuple[int, int, str, tuple]]:
        """Candidates with their features, by end and start."""
        return [(a, b, kind, self.features(key)) for a, b, kind, key in self.spans(text)]

    def label(self, text: str) -> list[tuple[int, int, str]]:
        """The best labelling of a text."""
        return self.best(text, self.spans(text))

    def best(self, text: str, lat: list[tuple[int, int, str, tuple]]) -> list[tuple[int, int, str]]:
        """The best labelling among the text's spans(); of equal ones that with the earlier, shorter segments.

        The best score with a candidate last is its own, and the best of: nothing before it; a last segment that ends too
        far before it to be a neighbour; a neighbour, with the weight of the two."""
        w, cache = self.model.weights, self.scores
        ends: list[int] = []
        best: list[tuple[float, int]] = []  # per candidate: best score with it last, the segment before
        first = (0.0, -1)  # best score so far, and the last segment
        top: list[tuple[float, int]] = [first]  # before each candidate: the same of those that end before
        end = -NEAR - 1
        for n, (a, b, kind, key) in enumerate(lat):
            s = cache.get(key)
            if s is None:
                s = sum([w.get(f, 0.0) for f in self.features(key)])
                if len(cache) > 500_000:
                    cache.clear()
                cache[key] = s
            if end < a - NEAR:  # all before end so far
                score, before = first
            else:
                k = bisect_right(ends, a)
                far = bisect_left(ends, a - NEAR, 0, k)
                score, before = top[far]
                for i in range(far, k):
                    both = lat[i][2], kind, text[lat[i][1] : a]
                    t = cache.get(both)
                    if t is None:
                        t = cache[both] = sum([w.get(f, 0.0) for f in pair_features(text, lat[i], a, kind)])
                    near = best[i][0] + t
                    if near > score:
                        score, before = near, i
            score += s
            best.append((score, before))
            ends.append(b)
            end = b
            if score > first[0]:
                first = score, n
            top.append(first)
        out = []
        at = first[1]
        while at >= 0:
            out.append(lat[at][:3])
            at = best[at][1]
        return out[::-1]


def code_of(key: tuple) -> str:
    """A segment's key as one string, from which key_of() makes one with the same features. No part but the last can hold the sign
    between them."""
    kind, form, word, mark, after, length = key
    return "\x1f".join((kind, word, mark, str(length), *map(str, form), "after" if after == "\x1f" else after))


def key_of(code: str) -> tuple:
    kind, word, mark, length, *form, after = code.split("\x1f")
    return kind, tuple(form), word, mark, "\x1f" if after == "after" else after, length


#: The labeller that this process had last.
KEPT: list[Labeller] = []


def labeller(model: Model) -> Labeller:
    """A labeller for the model; the tasks of one process share it, with what it found out about tokens."""
    if not KEPT or KEPT[0].model is not model:
        KEPT[:] = [Labeller(model)]
    return KEPT[0]


def pair_features(text: str, before: tuple, start: int, kind: str) -> tuple[str, str]:
    """Features of two neighbours: their kinds, and with them what stands between."""
    both = f"{before[2]}~{kind}"
    return both, f"{both}:{text[before[1] : start]}"


NAME_FORMS = frozenset(("G", "F", "G F", "F G", "C G", "G C", "C, G", "F, G", "I F", "F, I", "g f"))


def rule_labels(text: str, lattice: list[tuple[int, int, str, tuple]]) -> set[int]:
    """Numbers of the candidates that are segments by rule: the longest of overlapping ones that no counter-sign marks, those
    of a known form, and whole ones on one line, first."""
    return by_rule(text, lattice, [rule(kind, fs) for _, _, kind, fs in lattice])


def by_rule(text: str, lattice: list[tuple], rules: list[tuple[bool, bool, bool]]) -> set[int]:
    """The same with what rule() says of each candidate."""
    chosen: set[int] = set()
    begun, ended = [], []  # of the segments chosen, in the text's order
    for _, _, _, j in sorted([(r[0], r[1], c[0] - c[1], j) for j, (c, r) in enumerate(zip(lattice, rules)) if r[2]]):
        a, b, kind, _ = lattice[j]
        k = bisect_right(ended, a)
        if k < len(begun) and begun[k] < b:
            continue
        if kind in FIGURES and COUNTER_CUE.search(text[max(0, a - 14) : a].lower()):
            continue
        chosen.add(j)
        begun.insert(k, a)
        ended.insert(k, b)
    return chosen


def rule(kind: str, fs: tuple[str, ...]) -> tuple[bool, bool, bool]:
    """Whether a candidate has no known form, is a part of a number, and is a segment unless another one or what is before
    it forbids it."""
    if kind == "email":
        return False, False, "email:msgid:" not in fs[1]
    if kind in FIGURES:
        told = f"{kind}:is:{kind}" in fs or f"{kind}:cue" in fs or kind == "phone" and "phone:land" in fs
        return f"{kind}:rare" in fs, f"{kind}:part" in fs, told
    if kind == "name":
        form, sure = fs[2].split(":")[1:]
        return False, False, form in NAME_FORMS and int(sure) >= (2 if form in ("G", "F") and "nb:title" not in fs else 1 if form == "F, G" else 0)
    return False, False, True


class Chain(NamedTuple):
    """What labellings are made of: candidates with features, by end; per candidate the number of candidates that end too
    far before it to be neighbours, and the neighbours before it with the features of the two."""

    lattice: list[tuple[int, int, str, tuple]]
    far: list[int]
    near: list[list[tuple[int, tuple]]]


def chain(text: str, lattice: list[tuple[int, int, str, tuple]], pair: Callable[..., tuple] = pair_features) -> Chain:
    ends: list[int] = []
    far: list[int] = []
    near: list[list[tuple[int, tuple]] | tuple] = []
    end = -NEAR - 1
    for n, (a, b, kind, _) in enumerate(lattice):
        if end < a - NEAR:
            far.append(n)
            near.append(())
        else:
            far.append(f := bisect_left(ends, a - NEAR))
            k = bisect_right(ends, a, f)
            near.append([(i, pair(text, lattice[i], a, kind)) for i in range(f, k)] if k > f else ())
        ends.append(b)
        end = b
    return Chain(lattice, far, near)


def _add(x: float, y: float) -> float:
    return x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))


def sums(c: Chain, w: dict[str, float]) -> tuple[list[float], list[list[float]], float]:
    """Probability of each candidate, and of each candidate right behind each of its neighbours, under the model; and the
    log sum over all labellings. Sums run forward over the last segment, and their derivatives backward."""
    get = w.get
    s = [sum([get(f, 0.0) for f in fs]) for _, _, _, fs in c.lattice]
    t = [[sum([get(f, 0.0) for f in fs]) for _, fs in near] if near else () for near in c.near]
    return flow(c, s, t)


def flow(c: Chain, s: list[float], t: list) -> tuple[list[float], list[list[float]], float]:
    """The same for candidates that score `s` and neighbours that score `t`."""
    n = len(s)
    alpha, z, last, upto = [], [], 0.0, [0.0]  # upto[k]: log sum of labellings within the first k candidates
    keep: list[float] = []  # exp(upto[k] - upto[k + 1])
    for far, near, own, both in zip(c.far, c.near, s, t):
        y = upto[far]
        if near:
            for (i, _), x in zip(near, both):
                y = _add(y, alpha[i] + x)
        z.append(y)
        y += own
        alpha.append(y)
        if last > y:
            e = exp(y - last)
            last += log1p(e)
            keep.append(1.0 / (1.0 + e))
        else:
            e = exp(last - y)
            last = y + log1p(e)
            keep.append(e / (1.0 + e))
        upto.append(last)
    du, da = [0.0] * n + [1.0], [0.0] * n
    pairs: list[list[float]] = [[]] * n
    for j in range(n - 1, -1, -1):
        d, far = du[j + 1], c.far[j]
        stay = d * keep[j]
        own = da[j] = da[j] + (d - stay)
        du[j] += stay
        if near := c.near[j]:
            y = z[j]
            du[far] += own * exp(upto[far] - y)
            pairs[j] = [own * exp(alpha[i] + x - y) for (i, _), x in zip(near, t[j])]
            for (i, _), p in zip(near, pairs[j]):
                da[i] += p
        else:
            du[far] += own
    return da, pairs, upto[n]


def train(texts: list[str], shapes: dict[str, str] | None = None) -> Model:
    """Model from sample texts, in the order given, and the forms of numbers known; if None, those of the sample."""
    names, given = learn_names(texts)
    shapes = learn_shapes(texts) if shapes is None else shapes
    # in every third text no form is known, so that the weights of words before, lengths and the like learn to do without
    full, bare = Labeller(Model(names, given, {}, shapes)), Labeller(Model(names, given, {}, {}))
    climber, data = Climber(), []
    for i, t in enumerate(texts[:WEIGHT_ROWS]):
        lab = bare if i % 3 == 2 else full
        if spans := lab.spans(t):
            data.append(climber.ruled(t, spans, lab.entries(spans)))
    for _ in range(EPOCHS):
        for x in data:
            climber.climb(*x)
    return Model(names, given, climber.weights(), shapes)


class Climber:
    """Weights that climb. A feature's cell holds its weight, the sum of its squared gradients, the gradient of the step that is being
    made and whether that touches it; a candidate has its cells at hand, so that no step looks up a feature."""

    def __init__(self) -> None:
        self.cells: dict[str, list] = {}
        self.own: dict[str, tuple[list, ...]] = {}
        self.pairs: dict[tuple[str, str, str], tuple[list, ...]] = {}

    def cells_of(self, fs: tuple[str, ...]) -> tuple[list, ...]:
        return tuple([self.cells.setdefault(f, [0.0, 1e-6, 0.0, False]) for f in fs])

    def ruled(self, text: str, spans: list[tuple[int, int, str, tuple]], entries: list[tuple]) -> tuple[Chain, list, set[int], dict[int, int]]:
        """A text to learn from: its labellings, with the cells of candidates and neighbours, the segments by rule, and the segment
        before each."""
        own = []
        for fs, code, _ in entries:
            cells = self.own.get(code)
            if cells is None:
                cells = self.own[code] = self.cells_of(fs)
            own.append(cells)
        gold = by_rule(text, spans, [e[2] for e in entries])
        c = chain(text, spans, self.pair)
        follows, before = {}, -1
        for j in sorted(gold, key=lambda j: spans[j][0]):
            follows[j], before = before, j
        return c, own, gold, follows

    def pair(self, text: str, before: tuple, start: int, kind: str) -> tuple[list, ...]:
        both = before[2], kind, text[before[1] : start]
        found = self.pairs.get(both)
        if found is None:
            found = self.pairs[both] = self.cells_of(pair_features(text, before, start, kind))
        return found

    def climb(self, c: Chain, own: list, gold: set[int], follows: dict[int, int]) -> None:
        """One step up the likelihood of a text's segments."""
        p, pairs, _ = flow(c, [sum([x[0] for x in cells]) for cells in own], [[cells[0][0] + cells[1][0] for _, cells in near] if near else () for near in c.near])
        touched = []
        for j, x in enumerate(p):
            d = 1.0 - x if j in gold else -x
            if d > 1e-4 or d < -1e-4:
                for cell in own[j]:
                    if not cell[3]:
                        cell[3] = True
                        touched.append(cell)
                    cell[2] += d
            if c.near[j]:
                before = follows[j] if j in gold else -2
                for (i, cells), q in zip(c.near[j], pairs[j]):
                    d = 1.0 - q if before == i else -q
                    if d > 1e-4 or d < -1e-4:
                        for cell in cells:
                            if not cell[3]:
                                cell[3] = True
                                touched.append(cell)
                            cell[2] += d
        for cell in touched:
            now, square, g, _ = cell
            g -= DECAY * now
            square += g * g
            cell[:] = now + RATE * g / sqrt(square), square, 0.0, False

    def weights(self) -> dict[str, float]:
        """Weight per feature that a step has moved."""
        return {f: cell[0] for f, cell in self.cells.items() if cell[1] > 1e-6}


def learned(documents: DataFrame) -> tuple[DataFrame, Model]:
    """The rows (doc_id, text, lattice) with their candidates, and the model that all of them have taught."""
    rows = documents.count()
    counts = materialize(counted(documents), "p8-counts")
    model = Model(*names_of(counts, rows), {}, shapes_of(counts, rows))
    held = documents.sparkSession.sparkContext.broadcast(model)
    rounds, shards = -(-STEPS // max(rows, 1)), max(1, rows // SHARD_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab, climber = labeller(held.value), Climber()
        again, i = [], 0
        names = ["doc_id", "text", "lattice", "feature", "weight"]
        for b in batches:
            with uncollected():
                lattices = []
                texts = [x or "" for x in b.column(1).to_pylist()]
                for text, begun in zip(texts, begins(texts)):
                    spans = []
                    if text:
                        # in every third text no form is known, so that the weights of words before, lengths and the like learn to do without
                        spans, taught = lab.both_spans(text, begun) if i % 3 == 2 else (lab.spans(text, begun), None)
                        i += 1
                        entries = lab.entries(spans)
                        x = climber.ruled(text, spans, entries) if taught is None else climber.ruled(text, taught, lab.entries(taught))
                        if x[1]:
                            climber.climb(*x)
                            again += [x] * (rounds > 1)
                    lattices.append(packed(spans, entries) if spans else None)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lattices, pa.binary()), pa.nulls(n, pa.string()), pa.nulls(n, pa.float64())], names)
        with uncollected():
            for _ in range(rounds - 1):
                for x in again:
                    climber.climb(*x)
        w = climber.weights()
        n = len(w)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.array(list(w), pa.string()), pa.array(list(w.values()), pa.float64())], names)

    place = F.xxhash64("doc_id", "text")  # shards, and the order within, are the same for any order of the rows
    spread = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), place.alias("_at")).repartition(shards, "_at").sortWithinPartitions("_at", "doc_id")
    kept = materialize(spread.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string, lattice binary, feature string, weight double"), "p8-lattices")
    weights = kept.filter("feature IS NOT NULL").groupBy("feature").agg((F.sum("weight") / shards).alias("weight")).collect()
    return kept.filter("feature IS NULL").select("doc_id", "text", "lattice"), model._replace(weights={x.feature: x.weight for x in weights})


def sample_texts(documents: DataFrame, rows: int = TRAIN_ROWS) -> list[str]:
    """Texts of the rows with the least hashes of their ids: a bounded sample that no order of the rows changes."""
    kept = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id")
    ids = [r.doc_id for r in kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    got = documents.filter(F.col("doc_id").isin(ids)).select("doc_id", "text").collect() if ids else []
    place = {d: i for i, d in enumerate(ids)}
    return [r.text for r in sorted(got, key=lambda r: (place[r.doc_id], r.text or "")) if r.text][:rows]


def packed(spans: list[tuple[int, int, str, tuple]], entries: list[tuple]) -> bytes:
    """Candidates with their codes."""
    return marshal.dumps([*zip(*[(a, b, kind, e[1]) for (a, b, kind, _), e in zip(spans, entries)])])


NONE_FOUND = packed([], [])


def with_lattices(documents: DataFrame) -> DataFrame:
    """(doc_id, text, lattice), the last null if candidates have yet to be found."""
    lattice = F.coalesce("lattice", F.lit(NONE_FOUND)) if "lattice" in documents.columns else F.lit(None).cast("binary")
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", lattice.alias("lattice"))


def labelling(lab: Labeller, text: str, lattice: bytes | None) -> list[tuple[int, int, str]]:
    return lab.label(text) if lattice is None else lab.best(text, [*zip(*marshal.loads(lattice))])


def find(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, pii_kind, found_text): each distinct string once per row and kind; a line break in it is one space.

    Null and empty texts, and rows without an id, give nothing; ids are unique, a repeated one gives its rows' strings."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = labeller(held.value)
        for b in batches:
            ids, kinds, texts = [], [], []
            with uncollected():
                for doc, text, lat in zip(*(c.to_pylist() for c in b.columns)):
                    if not text:
                        continue
                    for kind, found in dict.fromkeys([(k, found.replace("\r\n", " ").replace("\n", " ") if "\n" in (found := text[x:y]) else found) for x, y, k in labelling(lab, text, lat)]):
                        ids.append(doc)
                        kinds.append(kind)
                        texts.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["doc_id", "pii_kind", "found_text"])

    return with_lattices(documents.filter("doc_id IS NOT NULL AND text IS NOT NULL")).mapInArrow(run, "doc_id bigint, pii_kind string, found_text string")


def redact(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, n_found): every segment replaced by its kind in brackets; the rest is unchanged. Null stays null."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = labeller(held.value)
        for b in batches:
            out, n = [], []
            with uncollected():
                for text, lat in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    spans = labelling(lab, text, lat) if text else []
                    parts, at = [], 0
                    for x, y, kind in spans:
                        parts += [text[at:x], f"[{kind.upper()}]"]
                        at = y
                    out.append("".join(parts) + text[at:] if text is not None else None)
                    n.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], ["doc_id", "text", "n_found"])

    return with_lattices(documents).mapInArrow(run, "doc_id bigint, text string, n_found int")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(*learned(table(spark, sf_dir, "documents")))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(*learned(table(spark, sf_dir, "documents")))
