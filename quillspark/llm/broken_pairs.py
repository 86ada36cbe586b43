"""Broken prompt and response pairs.

A suffix automaton over a prompt's words is traversed by each response to measure how much of it is copied; an
automaton of refusal phrases, a delimiter stack and stopword votes find the other defects. Where a text breaks
off without a visible sign, it is judged by how often its last words end a text or sentence anywhere in the
collection, and whether its last letters are met as a word or only as the beginning of words; these counts live in
tables of a fixed size that all rows feed. What is not known there is not held against a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.words import language, words

SLOTS = 1 << 20  # of the end statistics: a fixed size, whatever the collection's
MIN_RUN, MIN_WORDS, COVERAGE = 3, 5, 0.8
# What stands for no answer.
PLACEHOLDERS = "n a|na|n/a|null|none|nil|nan|tbd|tba|todo|blank|empty|undefined|missing|no answer|not available|not applicable|no response|unanswered|pending|xxx|lorem ipsum|placeholder|to be determined|to be added|answer here|insert answer".split("|")
# Placeholders that are words as well, and so no defect where they stand among the options without brackets.
_ALSO_OPTIONS = frozenset("none nil na undefined empty blank missing pending".split())
# A refusal by grammar: who speaks, what keeps the speaker, and what is not done, in every combination.
_GRAMMAR = [
    # English: the speaker is the one who answers, so "a firm cannot provide credit" is none.
    (
        "i|i also|i really|i simply|i just".split("|"),
        "can't|cannot|can not|couldn't|could not|won't|will not|won't be able to|will not be able to|shouldn't|should not|may not|must not|am unable to|am not able to|am not going to|am not allowed to|am not permitted to|am not willing to|am not in a position to|have no wish to|have no intention to|don't wish to|do not wish to|don't want to|do not want to|would rather not|prefer not to|would prefer not to|have to decline to|must decline to|decline to|refuse to|must refuse to|don't think i should|do not think i should|don't think i can|do not think i can|don't feel able to".split("|"),
        "answer|respond|reply|say|tell|provide|give|share|help|assist|offer|supply|discuss|comply|disclose|reveal|get into|go into|do that|do this|write|produce|fulfil|fulfill|complete this|complete that|continue with|support you|solve this|solve that|generate".split("|"),
    ),
    ("i|i also|i really".split("|"), "don't feel comfortable|do not feel comfortable|am not comfortable|won't be|will not be|have no intention of|am uncomfortable".split("|"), "answering|responding|replying|saying|telling|providing|giving|sharing|helping|assisting|offering|supplying|discussing|disclosing|writing|producing|solving|generating|doing that|doing this".split("|")),
    ("i'm|we're".split("|"), "unable to|not able to|not going to|not allowed to|not permitted to|not willing to|not in a position to|sorry but cannot".split("|"), "answer|respond|reply|say|tell|provide|give|share|help|assist|offer|supply|discuss|comply|disclose|reveal|get into|go into|do that|do this|write|produce|fulfil|fulfill|solve|generate".split("|")),
    ("we|the assistant|this assistant|the model|this model|the system|the author".split("|"), "can't|cannot|can not|are unable to|is unable to|won't|will not|declined to|declines to|refused to|refuses to|is not able to|is not allowed to|are not able to".split("|"), "answer|respond|reply|help you|help with|assist|comply|fulfil|fulfill|share|disclose|discuss|provide an|provide the|provide this|give an answer|give the answer|give you".split("|")),
    ("unable to|cannot|can't|can not|not able to|not permitted to|declining to|refusing to".split("|"), "comply with|answer this|answer that|respond to this|respond to that|assist with|help with|fulfil this|fulfill this|fulfil that|fulfill that|discuss this|discuss that".split("|"), [""]),
    ("it is|it's|it would be|it isn't|it is not|that is|that's|that isn't|this is|this isn't".split("|"), "inappropriate for me to|not appropriate for me to|appropriate for me to|possible for me to|not possible for me to|impossible for me to|not something i can|something i can't|something i cannot|something i won't|something i am not|something i'm not|something i will not".split("|"), [""]),
    ("the guidelines|my guidelines|guidelines|the policy|my policy|policy|policies|the rules|my rules|instructions".split("|"), "keep|prevent|prevents|stop|prohibit|prohibits|forbid|forbids|bar|do not allow|don't allow|does not allow|doesn't let|don't let".split("|"), "me|us".split("|")),
    # Spanish, French, German.
    ("no puedo|no podemos|no me es posible|no nos es posible|me es imposible|no debo|prefiero no|preferimos no|me niego a|lamento no poder|siento no poder|no estoy en condiciones de|no quiero".split("|"), "dar|ofrecer|ayudar|ayudarle|ayudarte|responder|escribir|proporcionar|contestar|compartir|facilitar|cumplir|hablar|decir|resolver|entregar".split("|"), [""]),
    ("je ne peux pas|je ne peux|je ne puis|je ne dois pas|je ne souhaite pas|je ne veux pas|nous ne pouvons pas|il m'est impossible de|il m'est impossible d'|je refuse de|je préfère ne pas|je préfère ne rien|je suis incapable de|je ne suis pas en mesure de".split("|"), "donner|fournir|aider|répondre|écrire|partager|proposer|vous aider|vous donner|dire|communiquer|résoudre|rédiger".split("|"), [""]),
    ("kann ich|darf ich|möchte ich|ich kann|ich darf|ich möchte|können wir|dürfen wir|wir können".split("|"), "|leider|hier|hierzu|dazu|dir|ihnen|das|darauf|diese frage|dir leider|ihnen leider".split("|"), "keine antwort|keine lösung|keine hilfe|keine auskunft|nicht helfen|leider keine|nicht beantworten|nicht antworten|nicht weiterhelfen|nichts sagen|nichts dazu|hier nicht|leider nicht|dazu nichts".split("|")),
]
_WHOLE = (
    "must refrain from|have to refrain from|against my guidelines|isn't possible for me|have to decline|must decline|i decline|rather not answer|rather not say|prefer not to answer|declined to answer|refused to answer|refuses to answer|declines to answer|"
    "no answer will be given|no answer can be given|no answer is given|request was declined|request is declined|falls outside what|falls outside of what|outside what the assistant|outside of what i|as an ai|as a language model|against policy|i'd rather not|i must decline|"
    "me niego a|je refuse|ich lehne|muss ich ablehnen|ich muss ablehnen|ich weigere mich"
).split("|")
# Words no sentence ends with, of all languages together.
DANGLING = set("the a an of and or to in with from by for as at into than because while since although whenever whose which that if but its their el la los las un una de del que y en con por para porque si cuando su der die das den dem ein eine und mit weil dass wenn von zu le les des et dans pour avec parce quand du au un une".split())
_TERMINAL = (".", "!", "?", "。", "…”")
_CLOSERS = "\"'”’»)]} \t\r\n​\xa0"


def refusal_automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for first, second, third in _GRAMMAR:
        for x in first:
            for y in second:
                for z in third:
                    auto.add_word(f" {' '.join(w for w in (x, y, z) if w)} ", 1)
    for p in _WHOLE:
        auto.add_word(f" {p} ", 1)
    auto.make_automaton()
    return auto


def _spoken(text: str) -> str:
    return " " + " ".join(re.findall(r"[^\W_]+(?:'[^\W_]+)*'?", text.lower().replace("’", "'"))) + " "


class SuffixAutomaton:
    """Of one sequence; ``longest`` yields, per item of another, the length of the longest match that ends there."""

    def __init__(self, seq: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for c in seq:
            cur = len(self.next)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.len[q] == self.len[p] + 1:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def longest(self, seq: list[str]) -> Iterator[int]:
        v = n = 0
        for c in seq:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.len[v]
            if c in self.next[v]:
                v = self.next[v][c]
                n += 1
            else:
                n = 0
            yield n


def copied_share(prompt: SuffixAutomaton, response: list[str], min_run: int = MIN_RUN) -> float:
    """Share of the response's words that lie in runs of at least ``min_run`` words of the prompt."""
    covered, upto = 0, 0
    for i, n in enumerate(prompt.longest(response), 1):
        if n >= min_run:
            covered += i - max(upto, i - n)
            upto = i
    return covered / len(response) if response else 0.0


def is_empty(answer: str | None, options: list[str] | None) -> bool:
    if answer is None:
        return True
    bare = answer.replace("​", "").replace("﻿", "").strip()
    if not words(bare):
        return True
    said = " ".join(words(bare))
    if said in _ALSO_OPTIONS and bare.isalpha() and options and any(o is not None and o.strip() == bare for o in options):
        return False
    return said in PLACEHOLDERS


def open_delimiter(text: str) -> bool:
    """Whether a bracket opened in the text stays open at its end."""
    pairs, stack = {")": "(", "]": "[", "}": "{"}, []
    for c in text:
        if c in "([{":
            stack.append(c)
        elif c in pairs and stack and stack[-1] == pairs[c]:
            stack.pop()
    return bool(stack)


def _shapes(text: str) -> tuple[list[str], list[bool]]:
    """Words as classes that recur (numbers as #, names inside a sentence as N), and whether a sentence or the text ends behind each."""
    out, ends = [], []
    start = True
    for m in re.finditer(r"([^\W\d_]+(?:['’][^\W\d_]+)*)|(\d+(?:[.,]\d+)*)|([.!?…]+)|([:;,/=()\[\]])", text):
        word, number, stop, mark = m.groups()
        if stop:
            if ends:
                ends[-1] = True
            start = True
            continue
        out.append("#" if number else mark if mark else "N" if word[0].isupper() and not start and word[1:].islower() else word.lower())
        ends.append(False)
        start = False
    if ends:
        ends[-1] = True
    return out, ends


_WORD, _BEGUN = "\x02", "\x03"  # in place of a context: a word as a whole, and as the beginning of longer ones


def _slots(context: tuple[str, ...]) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest("\x1f".join(context).encode())
    return h & (SLOTS - 1), (h >> 32) & (SLOTS - 1)


def _count_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    seen: Counter = Counter()
    ended: Counter = Counter()
    whole: Counter = Counter()  # words that surely are, as something stands behind them
    lone: Counter = Counter()  # answers of one word

    def flush() -> pa.RecordBatch:
        total, end = np.zeros((2, SLOTS), np.int64), np.zeros((2, SLOTS), np.int64)
        begun: Counter = Counter()
        for w, n in (whole + lone).items():
            begun[_WORD, w] += n
            for k in range(1, len(w)):
                begun[_BEGUN, w[:k]] += n
        for c, n in (seen + begun).items():
            for k, s in enumerate(_slots(c)):
                total[k, s] += n
                end[k, s] += ended.get(c, 0)
        k, s = np.nonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(total[k, s]), pa.array(end[k, s])], names=["k", "slot", "seen", "ended"])

    for b in batches:
        answers, explanations, options = (b.column(k).to_pylist() for k in range(3))
        # Options beside the answer are whole, and so tell how answers end.
        beside = [o for a, given in zip(answers, options) for o in given or () if o != a]
        for texts in (answers, explanations, beside):
            for text in texts:
                if not text:
                    continue
                w, ends = _shapes(text)
                whole.update(x for x in w[: len(w) if text.rstrip(_CLOSERS).endswith(_TERMINAL) or texts is beside else -1] if x.isalpha() and x != "N")
                if len(w) == 1 and texts is not beside and w[0].isalpha():
                    lone[w[0]] += 1
                for i in range(len(w)):
                    for n in range(1, 5):
                        if i + 1 >= n:
                            c = tuple(w[i + 1 - n : i + 1])
                            seen[c] += 1
                            if ends[i]:
                                ended[c] += 1
        if len(seen) > 2_000_000:
            yield flush()
            seen.clear()
            ended.clear()
            whole.clear()
            lone.clear()
    if seen:
        yield flush()


def _breaks_off(text: str, options: list[str] | None, total: np.ndarray, end: np.ndarray) -> bool:
    bare = text.strip()
    if not bare:
        return False
    if options:
        kept = [o.strip() for o in options if o]
        given = bare in kept
        if given and len(words(bare)) == 1 and bare.isalnum():
            return False
        # Part of one of the options, up to what follows the cut.
        cut = bare.rstrip(" ,;:…-(").rstrip(".") if not bare.endswith(".") or bare.endswith("...") else bare
        cut = cut.replace("(", "").strip()
        if not given and any(len(o) > len(cut) and o.startswith(cut) and len(words(cut)) > 1 for o in kept):
            return True
    if open_delimiter(bare):
        return True
    tail = bare.rstrip(_CLOSERS)
    if bare.endswith(("...", "…", ",", "(", "[", "{", "-", "–", "—", ":", ";")) and words(bare):
        return True
    if tail.endswith(_TERMINAL):
        return False
    w, _ = _shapes(bare)
    if not w:
        return False
    if len(w) > 1 and w[-1] in DANGLING or _cut_word(w[-1], total):
        return True
    if len(w) < 3:
        return False
    for n in range(min(4, len(w)), 0, -1):
        a, b = _slots(tuple(w[-n:]))
        k = 0 if total[0, a] <= total[1, b] else 1
        seen, ended = total[k, (a, b)[k]], end[k, (a, b)[k]]
        if seen >= (8 if n > 1 else 4):
            return bool(ended < 0.05 * seen)
    return False  # nothing is known of how such a text ends


def _cut_word(w: str, total: np.ndarray) -> bool:
    """Whether the letters are met as the beginning of words, hardly ever as a word."""
    if len(w) < 2 or not w.isalpha():
        return False

    def count(kind: str) -> int:
        a, b = _slots((kind, w))
        return int(min(total[0, a], total[1, b]))

    return count(_BEGUN) >= 3 and count(_BEGUN) > 20 * max(0, count(_WORD))


def _closed_breaks_off(text: str, total: np.ndarray) -> bool:
    """For a value with its unit, or true and false: no sentence, so only what no whole answer ends with."""
    bare = text.strip()
    w, _ = _shapes(bare)
    return open_delimiter(bare) or bare.endswith(("...", "…")) and bool(words(bare)) or bool(w) and not bare.endswith(_TERMINAL) and (len(w) > 1 or len(w[-1]) > 1) and _cut_word(w[-1].lower(), total)


def _finder(total_end, min_run: int, coverage: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, end = total_end.value
        refusals = refusal_automaton()
        for b in batches:
            ids, defects = [], []
            for qid, kind, text, options, answer, explanation in zip(*(b.column(k).to_pylist() for k in range(6))):
                found: set[str] = set()
                if is_empty(answer, options):
                    found.add("empty")
                asked = words(text)
                asked_in = language(asked)
                auto = SuffixAutomaton(asked)
                sentences = [words(x) for x in re.split(r"[.!?]+", text or "")] + [asked]
                for field, response in (("a", answer), ("e", explanation)):
                    if not response or field == "a" and "empty" in found:
                        continue
                    said = words(response)
                    refuses = next(refusals.iter(_spoken(response)), None) is not None
                    copies = copied_share(auto, said, min_run) >= coverage if len(said) >= MIN_WORDS else len(said) > 1 and said in sentences
                    if refuses:
                        found.add("refusal")
                    if copies:
                        found.add("copies_question")
                    spoken_in = language(said)
                    if asked_in and spoken_in and asked_in != spoken_in:
                        found.add("other_language")
                    closed = field == "a" and kind in ("true_false", "numerical")
                    if not refuses and not copies and (_closed_breaks_off(response, total) if closed else _breaks_off(response, options if field == "a" else None, total, end)):
                        found.add("truncated")
                for d in sorted(found):
                    ids.append(qid)
                    defects.append(d)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(defects, pa.string())], names=["question_id", "defect"])

    return find


def broken_pairs(df: DataFrame, min_run: int = MIN_RUN, coverage: float = COVERAGE) -> DataFrame:
    """(question_id, defect), distinct; defects are empty, truncated, refusal, copies_question and other_language.

    Reads question_id, question_type, question_text, options, correct_answer and explanation; other columns are
    not read. Defined cases: a null question_id names the row's defects with a null id; a null or blank answer is
    ``empty``, a null or empty explanation no defect; a null prompt can be copied by nothing and has no language;
    an answer that is one of the options is judged like any other, but that one word is never cut there, and words
    such as None are no placeholders; repeated rows count once; texts are read whole; an empty table gives no row.
    """
    s = lambda c: F.col(c).cast("string").alias(c)
    rows = df.select(s("question_id"), s("question_type"), s("question_text"), F.col("options"), s("correct_answer"), s("explanation")).distinct()
    counted = rows.select("correct_answer", "explanation", F.col("options").cast("array<string>").alias("options")).mapInArrow(_count_ends, "k int, slot int, seen bigint, ended bigint").groupBy("k", "slot").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    t = counted.toPandas()  # at most 2 * SLOTS rows
    tables = np.zeros((2, 2, SLOTS), np.int32)
    for n, c in enumerate(("seen", "ended")):
        tables[n, t["k"].to_numpy(np.int64), t["slot"].to_numpy(np.int64)] = np.minimum(t[c].to_numpy(np.int64), 2**31 - 1)
    shared = df.sparkSession.sparkContext.broadcast((tables[0], tables[1]))
    return rows.mapInArrow(_finder(shared, min_run, coverage), "question_id string, defect string").distinct()
