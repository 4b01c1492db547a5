import random

from lodestone.functions import analysis as A
from lodestone.functions.analysis import lexemes, spanish_stem

# Words and stems that the algorithm's authors publish as its sample.
SAMPLE = """che che checa chec checar chec checo chec checoslovaquia checoslovaqui chelo chel chemise chemis cheque chequ chequeo cheque cheques chequ
chester chest chetumaleños chetumaleñ cheyene cheyen chía chi chiapaneca chiapanec chiapas chiap chica chic chicago chicag chicana chican chicas chic
chicharrones chicharron chichimecas chichimec chicles chicl torá tor tórax torax torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor
torearlo tor toreó tore torero torer toreros torer tormenta torment tornado torn tornen torn torneo torne torneos torne tornillo tornill torniquete torniquet
toro tor toros tor torpedearon torped torpeza torpez torre torr torrencial torrencial torrenciales torrencial torrente torrent torreón torreon torres torr""".split()


def test_sample():
    for word, stem in zip(SAMPLE[::2], SAMPLE[1::2], strict=True):
        assert spanish_stem(word) == stem, word


def test_steps():
    pairs = {"rápidamente": "rapid", "posibilidades": "posibil", "constituyendose": "constitu", "tecnologías": "tecnolog", "contribuyentes": "contribuyent", "artículos": "articul", "impuestos": "impuest", "impuesto": "impuest", "declaración": "declar", "declaraciones": "declar", "pagándolos": "pag", "sigue": "sig", "a": "a", "": ""}
    assert {w: spanish_stem(w) for w in pairs} == pairs


def test_lexemes():
    assert lexemes("Las Tarifas, de la LEY 9635!", "spanish") == [None, "tarif", None, None, "ley", "9635"]
    assert lexemes("Foo-bar_baz é", "simple") == ["foo", "bar", "baz", "é"] and lexemes(None) == []


def test_endings_are_looked_up_not_tried():
    class Word(str):
        tried = 0

        def endswith(self, *x):
            Word.tried += 1
            return super().endswith(*x)

    assert spanish_stem(Word("posibilidades")) == "posibil" and Word.tried < 10
    rng = random.Random(7)
    for ends in (A._PRONOUN_ENDS, A._BEFORE_ENDS, A._STANDARD_ENDS, A._Y_ENDS, A._VERB_ENDS, A._RESIDUE_ENDS):
        some = sorted(ends.all)
        for _ in range(500):
            word, region = rng.choice(["", "a", "ñandu", "gu"]) + rng.choice(some) + rng.choice(["", "s", rng.choice(some)]), rng.randint(0, 9)
            assert A._longest(word, ends, region) == max((e for e in ends.all if word.endswith(e) and len(word) - len(e) >= region), key=len, default="")
