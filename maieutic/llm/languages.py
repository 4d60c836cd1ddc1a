"""The language of a text, by its script and its function words."""

from __future__ import annotations

import re

# Frequent function words of each language that is written in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and is to in that it for you what which does with on be this are as at by from or not would how why where when its an must so after before see their can while if but there have has had only we they them then than into",
    "de": "der die das und ist zu den dem des ein eine einen einer nicht mit für auf von im wird sich als auch aus bei nach wie wenn dann oder noch soll sehen nur weil bitte du deine ich sie er wir hat haben sind war so an bis über",
    "es": "el la los las de del que y en un una es se por con para su al lo como más pero qué debe quedar cuando cada primero luego todas dentro cuántas valor a no me está tu sin si ya hay sobre esta este",
    "fr": "le la les de des du et en un une est que qui dans pour pas sur au aux ce se par plus ne sont avec où quel quelle il elle faut chacun combien tu doit leur je me ta a on si à vous nous cette avant après",
    "it": "il lo gli di del della dei che è e in un una per con non sono si da nel nella più come questo ogni quando prima dopo anche quale cosa",
    "pt": "o os a as de do da dos das que e em um uma é se por com para não no na ao mais como cada quando antes depois são seu sua qual isso",
    "nl": "de het een en van is dat in op te niet met voor zijn aan er wordt als ook bij naar hoe wanneer dan nog moet alleen omdat je deze welke",
    "sv": "och att det är en ett som på av för med inte den till om har när från hur varför också eller måste du varje sedan bara vilken",
    "da": "og at det er en et som på af for med ikke den til om har når fra hvordan hvorfor også eller skal du hver kun hvilken efter blev",
    "no": "og at det er en et som på av for med ikke den til om har når fra hvordan hvorfor også eller må du hver bare hvilken etter ble",
    "fi": "ja on ei se että kun niin jos mutta tai myös joka mitä miten ovat sen siitä ennen jälkeen vain kuin ole mikä jokainen",
    "pl": "i w na z że nie się do jest to jak po co gdy ale dla od czy przez tylko każdy przed oraz są tego które być jaki",
    "cs": "a v na se je že to s z do pro ale jak když co nebo jen každý před po jsou není který jaké aby už být",
    "hu": "a az és hogy nem is egy van meg de ha mint csak minden vagy amely mi ez azt után előtt kell miért hogyan",
    "tr": "ve bir bu için ile de da ne mi olarak daha çok gibi her sonra önce ama nasıl neden değil olan hangi yalnızca",
    "id": "yang dan di ke dari untuk dengan ini itu tidak adalah pada akan atau juga apa bagaimana setiap sebelum sesudah hanya karena",
}
#: The languages of FUNCTION_WORDS in order.
NAMES = list(FUNCTION_WORDS)
#: Of a word that several languages have, each counts an equal part.
WEIGHTS: dict[str, dict[str, float]] = {}
for _name, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        WEIGHTS.setdefault(_w, {})[_name] = 1.0
for _w, _of in WEIGHTS.items():
    WEIGHTS[_w] = {k: 1.0 / len(_of) for k in _of}

# The ranges of letters that stand for a script.
_SCRIPTS = {
    "latin": "a-zß-öø-ɏ",
    "greek": "ͱ-Ͽἀ-῾",
    "cyrillic": "а-ӿ",
    "hebrew": "א-ת",
    "arabic": "ء-ي",
    "devanagari": "ऄ-ह",
    "thai": "ก-ฮ",
    "kana": "ぁ-ヿ",
    "han": "㐀-鿿",
    "hangul": "가-힣",
}
_LETTERS = {k: re.compile(f"[{v}]") for k, v in _SCRIPTS.items()}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Least weight of function words, and how many times that of the other language, for a text to be clearly of a language; least letters of a script without function words.
LEAST_WEIGHT, CLEAR, LEAST_LETTERS = 1.5, 1.5, 12


def profile(text: str) -> dict[str, float]:
    """How much speaks for each language: function words, and for scripts that are not Latin a twelfth of the letters."""
    low = text.lower()
    out: dict[str, float] = {}
    for t in _TOKEN.findall(low):
        for k, w in WEIGHTS.get(t, {}).items():
            out[k] = out.get(k, 0.0) + w
    if not low.isascii():
        for k, p in _LETTERS.items():
            n = len(p.findall(low)) if k != "latin" else 0
            if n:
                out[k] = LEAST_WEIGHT * n / LEAST_LETTERS
        if "kana" in out:  # Japanese, whose Chinese characters speak for it too
            out["kana"] += out.pop("han", 0.0)
    return out


def main_language(found: dict[str, float]) -> str | None:
    """The language that most speaks for; of equal ones the first by name; None below LEAST_WEIGHT."""
    best = min(found, key=lambda k: (-found[k], k), default=None)
    return best if best is not None and found[best] >= LEAST_WEIGHT else None


def languages_differ(one: dict[str, float], other: dict[str, float]) -> bool:
    """Whether two texts are clearly in different languages.

    Each one's main language must speak CLEAR times as much for it as the other's does,
    so that languages akin to either do not blur the answer.
    """
    a, b = main_language(one), main_language(other)
    if a is None or b is None or a == b:
        return False
    return one[a] >= CLEAR * one.get(b, 0.0) and other[b] >= CLEAR * other.get(a, 0.0)
