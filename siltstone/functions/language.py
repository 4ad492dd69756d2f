"""Language of a passage from character trigram profiles."""

from __future__ import annotations

from collections import Counter
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shorter texts aren't judged.
LEAST = 20
_SEEDS = {
    "en": "the and of to in is that it was for with as on be by this are from or have an they which you were her all she there would their we him been has when who will no more if out so what up its about than into them can only other time new some could these two may first then do any my now such like our over me even most made after also did many must before back see where get much go well",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au aux avec ce cette il elle ils nous vous je ne plus par mais ou son sa ses leur comme tout faire sont été être avoir fait bien deux même aussi sans peut après entre très où encore moins notre quand depuis jamais toujours rien quelque déjà peau crème utilisé semaines",
    "de": "der die das und ist in zu den von mit sich des auf für nicht ein eine einen einem als auch es an werden aus er hat dass sie nach wird bei um am sind noch wie über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn kann schon doch unter gegen sehr jetzt immer ich mich wir haut wochen",
    "es": "el la los las de del que y en un una es por con no para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro piel semanas años está había",
    "it": "il lo la i gli le di del della che e è in un una per con non si da al sono come più ma anche ha questo questa nel nella dei delle alla o se ci mi suo sua loro molto tutto tutti quando dove perché essere fatto ancora dopo prima senza stato ogni così pelle settimane",
    "pt": "o a os as de do da dos das que e em um uma é para com não no na por mais se como mas foi ao ele ela seu sua ou quando muito já também só pelo pela até isso entre era depois sem mesmo aos ter seus quem nas me esse eles você essa num nem suas meu pele semanas não são está",
    "nl": "de het een en van in is dat op te zijn voor met die niet aan er om ook als dan maar bij nog uit wel naar heb heeft hij ze we je ik was worden wordt door over tot kan meer al geen zo deze dit mijn hun waar hier toen veel moet zonder huid weken",
}


@cache
def _profiles() -> dict[str, dict[str, float]]:
    out = {}
    for name, words in _SEEDS.items():
        grams = Counter(g for w in words.split() for g in _grams(w))
        total = sum(grams.values())
        out[name] = {g: n / total for g, n in grams.items()}
    return out


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def detect(text: str | None, margin: float = 1.1) -> str | None:
    """Lower-case ISO 639-1 code; null if the text is short or the answer unclear."""
    if text is None or len(text) < LEAST:
        return None
    grams = Counter(g for w in "".join(c.lower() if c.isalpha() else " " for c in text).split() for g in _grams(w))
    scores = sorted(((sum(n * p.get(g, 0.0) for g, n in grams.items()), name) for name, p in _profiles().items()), reverse=True)
    return scores[0][1] if scores[0][0] > 0 and scores[0][0] >= margin * scores[1][0] else None


@F.pandas_udf(T.StringType())
def detected(text: pd.Series) -> pd.Series:
    return text.map(detect)
