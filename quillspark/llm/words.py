"""Words and language votes shared by the text operators."""

from __future__ import annotations

import re
from collections import Counter

#: Fixed pattern: a word is a maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")

# Frequent function words by language.
STOPWORDS = {
    "en": "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into has look two more go see no way could my than been who its now did get come may part over only because while since once before after whose say says does every under".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho si entonces cuál cómo hacia hasta puede pueden cada mientras aunque luego después antes".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn etwa lang weil dabei was warum ich kann keine wir ihr uns mir hatte doch dann da".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son mais comme ou si leur y dont cette nous vous tout on aux sa ses été aussi deux même ces lors après sans elle être fait entre vers chez jusqu alors quand pendant parce pourquoi peu je à où peut ils elles cela donc".split(),
}
_VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words):
        _VOTES.setdefault(_w, []).append(_lang)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def language(tokens: list[str], least: float = 2.0) -> str | None:
    """The language with most stopword votes, a word shared by several counting less; None below ``least`` or in a tie."""
    votes: dict[str, float] = {}
    counts = Counter(tokens)
    for t in sorted(counts.keys() & _VOTES.keys()):
        langs = _VOTES[t]
        for lang in langs:
            votes[lang] = votes.get(lang, 0.0) + counts[t] / len(langs)
    if not votes:
        return None
    ranked = sorted(votes.items(), key=lambda x: (-x[1], x[0]))
    if ranked[0][1] < least or len(ranked) > 1 and ranked[1][1] >= 0.85 * ranked[0][1]:
        return None
    return ranked[0][0]
