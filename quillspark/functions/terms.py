"""Which phrases can name a concept, and which names are one: rules on terms as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Words no concept begins with, and words none ends with.
LEADING = """
the a an this that these those its their our your his her each every all any some no one two three what which who whom
whose when where why how if then than as at by for from in into of on or so to we you they he she it note see figure
table exercise example summary overview introduction conclusion definition theorem lemma proof chapter section part unit
lesson topic step rule using given let suppose consider recall remember prove
""".split()
TRAILING = "the a an of and or to in for is are".split()
# Connectives and words of instruction that open sentences.
DISCOURSE = """
after again against along already also although always among another anyway apart around because before behind below
beside beyond both briefly but certainly clearly consequently considering correspondingly currently definitely else
especially even eventually evidently finally first firstly following for former formerly further furthermore generally
given hence here hereafter hereby however indeed instead just last later latter likewise meanwhile moreover namely nearby
neither nevertheless next nonetheless normally notably now nowhere otherwise overall particularly perhaps please
previously primarily rather recently similarly since somehow specifically still subsequently such suppose surely then
thereafter thereby therefore thus together typically unless unlike until usually versus whenever whereas whereby while yet
assuming obviously place select note choose compute find denote consider apply use used show keep look see follow return
compare sort order start begin result results case cases way ways give take make made call called set put add remove check
ensure conduct count going grand let supposing
""".split()
# Modifiers and people that are no concept alone.
SINGLE = """
static dynamic multi single various different similar particular certain several few many much more most less least other
another such own same able available possible impossible capable suitable ready due likely unlikely true false new old
good bad high low great small large huge major minor core basic main primary secondary final initial total overall whole
full empty free open close fast slow easy hard simple complex variety common general specific multiple developers developer
users user administrators administrator engineers engineer architects architect customers customer clients client teams
team people members member audiences audience
""".split()
# Marks of a clause, fillers, and verbs that show a sentence where they stand inside a term.
CLAUSE = """
that which where who whom whose when while upon into onto toward towards itself themselves himself herself myself yourself
therefore however although though meanwhile wouldn couldn shouldn didn doesn don isn aren wasn weren cannot can't won't
don't
""".split()
FILLERS = ["term of art", "art in soa", "commonly used", "set of linked", "different contexts", "set of rules", "console in different", "plays the role", "service where two", "with", "many", "core values include"]
# Verbs of procedures; their forms follow by rule.
VERBS = """
distribute adjust ensure provide allow enable require depend support perform operate execute manage create build run scale
deploy configure handle process store send receive connect deliver serve optimize secure monitor access define maintain
generate analyze calculate evaluate identify illustrate select specify summarize validate verify contain include consist
produce reduce increase improve enhance protect work help make take give find keep show start end stop begin move bring
hold put set get leave lead mean look feel seem become grow turn stand fall pass fail commit pay test learn teach read write
act bind describe display combine present respond expose occur
""".split()
# Past forms that follow no rule, and verbs that double their last letter.
PAST = {"build": "built", "run": "", "send": "sent", "make": "made", "take": "taken", "give": "given", "find": "found", "keep": "kept", "show": "shown showed", "begin": "began begun", "bring": "brought", "hold": "held", "put": "", "set": "", "get": "got", "leave": "left", "lead": "led", "mean": "meant", "feel": "felt", "become": "became", "grow": "grew grown", "stand": "stood", "fall": "fell fallen", "pay": "paid", "teach": "taught", "read": "", "write": "written", "bind": "bound"}
DOUBLING = frozenset("run stop begin put set get commit occur".split())


def forms(verb: str) -> list[str]:
    """A verb with its third person, participle and past."""
    y = verb.endswith("y") and verb[-2] not in "aeiou"
    third = verb + "es" if verb.endswith(("s", "x", "z", "ch", "sh")) else verb[:-1] + "ies" if y else verb + "s"
    stem = verb + verb[-1] if verb in DOUBLING else verb[:-1] if verb.endswith("e") and not verb.endswith("ee") else verb
    past = PAST[verb].split() if verb in PAST else [stem[:-1] + "ied" if y else stem + "ed"]
    return [verb, third, stem + "ing", *past]


ACTIONS = sorted({f for v in VERBS for f in forms(v)})
INSIDE = sorted({f for v in "present require respond expose perform provide determine display play describe contain create".split() for f in forms(v)[1:]})
# Words of documents, calendars and lessons that are no concept; plurals follow by rule.
FURNITURE = """
system method process thing item example chapter section figure table definition equation problem solution page paper
annexure appendix syllabus curriculum textbook reference bibliography index content preface foreword acknowledgement
certificate university college school department institute board professor lecturer teacher student author name date time
hour minute mark total grade score question answer note remark instruction second year month day monday tuesday wednesday
thursday friday saturday sunday january february march april may june july august september october november december
diagram visual picture image flowchart chart graph measure measurement long short high low developing developed effect cause
advantage disadvantage benefit limitation feature characteristic type application use importance need role function
objective goal aim purpose principle concept overview introduction conclusion summary background history evolution
statistic data information detail description meaning difference similarity comparison classification category component
element part structure property nature scope significance impact consequence outcome result reason factor issue challenge
technique tool step stage phase action activity task operation event situation condition case scenario illustration
demonstration practice implementation deployment execution performance evaluation assessment test examination inspection
review audit check control monitoring monitor tracking track tracing trace observation analysis study research investigation
inquiry survey experiment trial don doesn didn isn aren wasn weren hasn haven hadn won wouldn couldn shouldn mightn mustn
significant important key
""".split()


def _plural(w: str) -> str:
    return "analyses" if w == "analysis" else w[:-1] + "ies" if w.endswith("y") and w[-2] not in "aeiou" else w + "es" if w.endswith(("s", "x", "ch", "sh")) else w + "s"


STOP_TERMS = sorted({x for w in FURNITURE for x in (w, _plural(w))})
# Names that mean one thing, and names that look alike but must never be one.
EQUIVALENT = {
    "Acceleration": ["acceleration", "rate of change of velocity", "time rate of change of velocity", "derivative of velocity", "second derivative of position", "second derivative of displacement"],
    "Velocity": ["velocity", "rate of change of displacement", "rate of change of position", "derivative of displacement", "derivative of position"],
    "Newton's Second Law of Motion": ["newton's second law", "newtons second law", "newton's 2nd law", "newtons 2nd law", "newton ii law", "newtons second law of motion", "newton's second law of motion", "newton second law"],
    "Newton's First Law of Motion": ["newton's first law", "newtons first law", "newton's 1st law", "newtons 1st law", "newton i law", "newton's law of inertia", "law of inertia", "newtons first law of motion", "newton's first law of motion"],
    "Newton's Third Law of Motion": ["newton's third law", "newtons third law", "newton's 3rd law", "newtons 3rd law", "newton iii law", "action and reaction law", "law of action and reaction", "newtons third law of motion", "newton's third law of motion"],
    "Conservation of Energy": ["conservation of energy", "law of conservation of energy", "principle of conservation of energy", "first law of thermodynamics"],
    "Conservation of Momentum": ["conservation of momentum", "law of conservation of momentum", "principle of conservation of momentum", "conservation of linear momentum"],
    "Gauss's Law": ["gauss's law", "gauss law", "gauss' law", "gauss flux theorem", "gauss's flux theorem"],
}
NEAR_MISSES = [
    ["newton's first law", "newton's second law", "newton's third law"], ["speed", "velocity"], ["mass", "weight"], ["distance", "displacement"], ["potential energy", "kinetic energy", "thermal energy"],
    ["linear momentum", "angular momentum"], ["scalar", "vector", "tensor"], ["heat", "temperature"], ["stress", "strain"], ["accuracy", "precision"],
]
# Numerals of surface keys.
SURFACE_NUMERALS = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10", "first": "1", "1st": "1", "second": "2", "2nd": "2", "third": "3", "3rd": "3", "fourth": "4", "4th": "4", "fifth": "5", "5th": "5"}


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def trimmed(term: Column) -> Column:
    """Without words no concept begins with at the front and words none ends with at the end; empty where nothing is left."""
    w = _words(term)
    front = F.aggregate(w, F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) == 0) & F.lower(x).isin(LEADING), a).otherwise(F.array_append(a, x)))
    back = F.aggregate(F.reverse(front), F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) == 0) & F.lower(x).isin(TRAILING), a).otherwise(F.array_append(a, x)))
    return F.array_join(F.reverse(back), " ")


def is_fragment(term: Column) -> Column:
    """Whether a term is an action, a clause, a sentence's rest or a mere modifier."""
    clean = F.regexp_replace(F.trim(term), r"[:;,.!?]+$", "")
    low = F.lower(clean)
    w = F.transform(_words(low), lambda x: F.regexp_replace(x, r"""^[.,;:!?()\[\]{}"']+|[.,;:!?()\[\]{}"']+$""", ""))
    first, last = F.element_at(w, 1), F.element_at(w, -1)
    inner = F.slice(w, 2, F.greatest(F.lit(0), F.size(w) - 2))
    return (
        (F.length(clean) < 3)
        | low.isin(FILLERS) | low.isin(SINGLE) | low.isin(ACTIONS)
        | (low.endswith("ly") & (F.length(low) > 4) & ~F.contains(low, F.lit(" ")))
        | (F.size(w) == 0)
        | ((F.size(w) == 1) & (first.isin(SINGLE) | first.isin(ACTIONS) | first.isin("with", "many", "few", "some", "any", "every")))
        | first.isin(ACTIONS) | first.isin(LEADING)
        | last.isin(ACTIONS) | last.isin(TRAILING) | last.isin("upon", "to", "for", "in", "with", "using")
        | F.exists(w, lambda x: x.isin(CLAUSE))
        | F.exists(inner, lambda x: x.isin(INSIDE))
        | F.trim(term).endswith(":") | term.rlike(r"[{}\[\]]")
    )


def _content(term: Column) -> Column:
    return F.filter(_words(term), lambda x: ~F.lower(x).isin(LEADING))


def is_discourse(term: Column) -> Column:
    """Whether all content words are connectives."""
    w = _content(term)
    return (F.size(w) > 0) & F.forall(w, lambda x: F.lower(x).isin(DISCOURSE))


def person_keys(text: Column) -> Column:
    """Small-letter tokens of names: those before an id in brackets (within 80 letters), and surnames of author lists."""
    spans = F.regexp_extract_all(text, F.lit(r"(?s)(.{0,80})\(\s*[A-Z0-9]{6,}\s*\)"), F.lit(1))
    named = F.flatten(F.transform(spans, lambda s: F.filter(F.regexp_extract_all(s, F.lit(r"[A-Z][A-Za-z']+"), F.lit(0)), lambda t: ~F.lower(t).isin(STOP_TERMS))))
    listed = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]{2,}),\s+[A-Z]\."), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.concat(named, listed), F.lower)))


def is_person(term: Column, keys: Column) -> Column:
    w = _content(term)
    return (F.size(w) > 0) & F.forall(w, lambda x: F.array_contains(keys, F.lower(x)))


def surface_key(text: Column) -> Column:
    """Key of a name as it is written: no possessive, no punctuation but hyphens, numerals and ordinals as digits."""
    bare = F.regexp_replace(F.translate(F.lower(F.trim(text)), "’`", "''"), r"'s\b", "")
    table = F.create_map(*[F.lit(x) for kv in SURFACE_NUMERALS.items() for x in kv])
    return F.array_join(F.transform(_words(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s-]", " ")), lambda w: F.coalesce(table[w], w)), " ")


def py_surface_key(text: str) -> str:
    """The same for one constant."""
    import re

    bare = re.sub(r"'s\b", "", text.lower().strip().replace("’", "'").replace("`", "'"))
    return " ".join(SURFACE_NUMERALS.get(w, w) for w in re.sub(r"[^\w\s-]", " ", bare).split())


def is_near_miss(a: Column, b: Column) -> Column:
    """Whether two names belong to one set of names that must never be merged."""
    ka, kb = surface_key(a), surface_key(b)
    out = F.lit(False)
    for names in NEAR_MISSES:
        keys = [py_surface_key(n) for n in names]
        has = lambda k: F.greatest(*[F.contains(k, F.lit(x)) for x in keys])  # noqa: E731, B023
        out = out | (has(ka) & has(kb))
    return out & (ka != kb)


def equivalent(term: Column) -> Column:
    """The name that stands for a term of one meaning, null where none is known."""
    key = surface_key(term)
    out = F.lit(None).cast("string")
    for name, phrases in reversed(EQUIVALENT.items()):
        out = F.when(key.isin(sorted({py_surface_key(p) for p in phrases})), name).otherwise(out)
    return out


def are_variants(a: Column, b: Column) -> Column:
    return (surface_key(a) == surface_key(b)) & ~is_near_miss(a, b)


def misconception_key(concept_id: Column, description: Column) -> Column:
    norm = F.array_join(_words(F.lower(description)), " ")
    return F.concat(F.lit("misc_"), concept_id, F.lit("_"), F.substring(F.sha2(F.concat(concept_id, F.lit(":"), norm), 256), 1, 10))


