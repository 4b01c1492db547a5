"""Analyzers: from a text to its lexemes and their places.

``simple`` takes lower-case runs of letters and digits. ``spanish`` leaves out stop words (they keep their
places) and cuts endings by the published Snowball algorithm. Both are plain Python for use within Arrow
batches; a task works each distinct word out once, and remembers a bounded number of them.
"""

from __future__ import annotations

import re
from functools import lru_cache

WORD = re.compile(r"[^\W_]+")

# Spanish function words that searches leave out.
STOP_WORDS = frozenset(
    """a al algo ante antes aquel aquella aquellas aquello aquellos aqui asi aun bajo bien cabe cada como con contra cual cuales cuando cuanto
    de del desde donde dos durante e el ella ellas ello ellos en entre era eran eres es esa esas ese eso esos esta está estaba estaban estamos
    están estar estas este esto estos estoy fue fueron fui ha había habían han has hasta hay haber he hemos la las le les lo los mas más me mi
    mis mucho muchos muy nada ni no nos nosotros o os otra otras otro otros para pero poco por porque pues que qué quien quienes se según ser
    será serán si sí sido sin sobre sois somos son soy su sus suya suyas suyo suyos también tan tanto te tiene tienen todo todos tu tus un una
    uno unos vosotros y ya yo él""".split()
)

_VOWELS = "aeiouáéíóúü"
# The endings of the published algorithm, by step.
_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_BEFORE_PRONOUN = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir", "ando": "ando", "iendo": "iendo", "ar": "ar", "er": "er", "ir": "ir"}
_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_AFTER_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
_CHANGED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
_IDAD, _IVA = ["idad", "idades"], ["iva", "ivo", "ivas", "ivos"]
_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_EN = "en es éis emos".split()
_VERB = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías
    irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron
    ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis
    ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""".split()
_RESIDUE, _RESIDUE_E = "os a o á í ó".split(), "e é".split()
_ACUTE = str.maketrans("áéíóú", "aeiou")


class _Ends:
    """Endings that are looked up by the last letters of a word: by their last letter their lengths, longest first."""

    def __init__(self, *lists):
        self.all = frozenset(x for xs in lists for x in xs)
        self.lengths = {z: sorted({len(x) for x in self.all if x[-1] == z}, reverse=True) for z in {x[-1] for x in self.all}}


_PRONOUN_ENDS, _BEFORE_ENDS = _Ends(_PRONOUNS), _Ends(_BEFORE_PRONOUN)
_STANDARD_ENDS = _Ends(_PLAIN, _AFTER_IC, _CHANGED, ["amente", "mente"], _IDAD, _IVA)
_Y_ENDS, _VERB_ENDS, _RESIDUE_ENDS = _Ends(_Y), _Ends(_EN, _VERB), _Ends(_RESIDUE, _RESIDUE_E)


# behind the first vowel, behind the first consonant, and behind the first consonant that follows a vowel
_VOWEL, _CONSONANT, _REGION = (re.compile(x.format(v=_VOWELS)) for x in ("[^{v}]*[{v}]", "[{v}]*[^{v}]", "[^{v}]*[{v}]+[^{v}]"))


def _after(pattern: re.Pattern, word: str, begin: int) -> int:
    """Where what is found from ``begin`` on ends, or the word's end."""
    found = pattern.match(word, begin)
    return found.end() if found else len(word)


def _regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    if len(word) < 3:
        rv = len(word)
    elif word[1] not in _VOWELS:
        rv = _after(_VOWEL, word, 2)
    elif word[0] in _VOWELS:
        rv = _after(_CONSONANT, word, 2)
    else:
        rv = 3
    r1 = _after(_REGION, word, 0)
    return rv, r1, _after(_REGION, word, r1)


def _longest(word: str, ends: _Ends, region: int = 0) -> str:
    room = len(word) - region
    for n in ends.lengths.get(word[-1:], ()):
        if n <= room and word[-n:] in ends.all:
            return word[-n:]
    return ""


def _without(word: str, endings: list[str], region: int) -> str:
    """Cut the longest of the endings, if it lies in the region."""
    found = max((e for e in endings if word.endswith(e)), key=len, default="")
    return word[: -len(found)] if found and len(word) - len(found) >= region else word


def _pronoun(word: str, rv: int) -> str:
    found = _longest(word, _PRONOUN_ENDS)
    if not found or len(word) - len(found) < rv:
        return word
    rest = word[: -len(found)]
    before = _longest(rest, _BEFORE_ENDS, rv)
    if before:
        return rest[: -len(before)] + _BEFORE_PRONOUN[before]
    return rest if rest.endswith("uyendo") and len(rest) - 5 >= rv else word


def _standard(word: str, r1: int, r2: int) -> str:
    found = _longest(word, _STANDARD_ENDS)
    at = len(word) - len(found)
    if not found or at < (r1 if found == "amente" else r2):
        return word
    rest = word[:at]
    if found in _CHANGED:
        return rest + _CHANGED[found]
    if found in _AFTER_IC:
        return _without(rest, ["ic"], r2)
    if found == "amente":
        if rest.endswith("iv"):
            short = _without(rest, ["iv"], r2)
            return _without(short, ["at"], r2) if short != rest else rest
        return _without(rest, ["os", "ic", "ad"], r2)
    if found == "mente":
        return _without(rest, ["ante", "able", "ible"], r2)
    if found in _IDAD:
        return _without(rest, ["abil", "ic", "iv"], r2)
    if found in _IVA:
        return _without(rest, ["at"], r2)
    return rest


def _verb(word: str, rv: int) -> str:
    found = _longest(word, _Y_ENDS, rv)
    if found and word[: -len(found)].endswith("u"):
        return word[: -len(found)]
    found = _longest(word, _VERB_ENDS, rv)
    if not found:
        return word
    rest = word[: -len(found)]
    return rest[:-1] if found in _EN and rest.endswith("gu") else rest


def _residue(word: str, rv: int) -> str:
    found = _longest(word, _RESIDUE_ENDS, rv)
    if not found:
        return word
    rest = word[: -len(found)]
    return rest[:-1] if found in _RESIDUE_E and rest.endswith("gu") and len(rest) - 1 >= rv else rest


def spanish_stem(word: str) -> str:
    """The stem of a lower-case word."""
    rv, r1, r2 = _regions(word)
    word = _pronoun(word, rv)
    cut = _standard(word, r1, r2)
    if cut == word:
        cut = _verb(word, rv)
    return _residue(cut, rv).translate(_ACUTE)


@lru_cache(maxsize=200_000)
def _spanish(word: str) -> str | None:
    return None if word in STOP_WORDS else spanish_stem(word)


def lexemes(text: str | None, analyzer: str = "simple") -> list[str | None]:
    """The lexeme of each word in order; None for a stop word."""
    words = WORD.findall((text or "").lower())
    if analyzer == "simple":
        return words
    if analyzer == "spanish":
        return list(map(_spanish, words))
    raise ValueError(f"unknown analyzer {analyzer!r}")
