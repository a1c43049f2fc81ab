"""Problem 1: spellings of the same person or organisation.

Close tokens come from a join on what is left of them without one letter, or without two where two edits are allowed: only tokens about as
close as that share it, so that the pairs compared grow with the vocabulary and not with its square. For tokens longer than ``DELETED_UP_TO`` it is
pairs of their rarest q-grams (a prefix-filtered set-similarity join).
A string is found by the rarest of its tokens, as many as are needed that the rest cannot reach the similarity alone, and by
the tokens close to them; so a family name that a third of all strings share is no meeting point. Persons are found by pairs
of a family name and a form of the first name or its letter as well, as the verifier asks no more of them. Candidates are
verified by soft weighted token similarity: tokens may match through an edit, an abbreviation, initials or a familiar form, and
weigh the more the rarer they are.

Strings with full first names are linked into components; strings with initials only join the component they fit, if it is
the only one. All pairs of a component are the result; the membership is given by ``link``.

Defined results: null and blank strings and types other than the given ones make no pairs; repeated rows count once; a string without
letters links to nothing but strings that look the same.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.canonlist import edits, fold
from maskwright.llm.components import components
from maskwright.llm.lookalike import skeleton
from maskwright.runtime import cut, discard, once

Q = 3
#: Letters up to which what is left without a letter or two is listed; longer tokens have q-grams instead, as there are too many ways.
DELETED_UP_TO = 18
#: Letters from which two edits are allowed instead of one, and below which none is.
TWO_EDITS_FROM, EDITS_FROM = 10, 3
#: An edit touches at most Q + 1 of a token's q-grams; so a token longer than this has two that it leaves alone.
GRAMS_FROM = Q + 2
#: Weighted share of tokens that must match.
SIMILARITY = 0.8

# What stands before or around names without being part of them.
TITLES = frozenset("dr prof ing dipl mag mr mrs ms miss mx sir frau herr hr fr mme mlle m monsieur madame sr sra srta senor senora sig signor signora signore dott avv phd md jr".split())
LEGAL_FORMS = frozenset("gmbh ag kg ohg ug se ltd limited plc llc llp inc incorporated corp corporation co sa sarl sas srl spa sl slu bv nv".split())
LEGAL_PHRASES = tuple(
    "gesellschaft mit beschrankter haftung|kommanditgesellschaft|aktiengesellschaft|societe anonyme|sociedad anonima|societa per azioni|societa a responsabilita limitata|"
    "besloten vennootschap|naamloze vennootschap|public limited company|limited liability company".split("|")
)
JOINERS = frozenset("and und et y e the fa firma firm company".split())
PARTICLES = frozenset("van von de di der den del della la le zu zum da dos".split())
# Familiar forms, each with the names it stands for.
FAMILIAR = {
    short: frozenset(full.split())
    for short, full in (
        line.split(":")
        for line in "alex:alexander alessandra alexandra|sasha:alexander alessandra|sandra:alessandra alexandra|andy:andreas andrew|tony:anthony|ben:benjamin|benny:benjamin|bea:beatrice|"
        "bob:robert|bobby:robert|rob:robert|bert:robert|bill:william|billy:william|will:william|willy:william|liam:william|wolf:wolfgang|charlie:charles|chuck:charles|chris:christine christopher christian|"
        "tina:christine christina|concha:concepcion|conchita:concepcion|dan:daniel|danny:daniel|debbie:deborah|deb:deborah|dick:richard|rick:richard|ricky:richard|rich:richard|lola:dolores|"
        "lolita:dolores|domi:dominique|ed:edward|eddie:edward|ted:edward|teddy:edward|ned:edward|beth:elizabeth elisabeth|liz:elizabeth elisabeth|lizzy:elizabeth|betty:elizabeth|lisa:elisabeth elizabeth|"
        "elli:elisabeth|elsa:elisabeth|ella:elisabeth|franca:francesca|cesca:francesca|fran:francesca francisco|paco:francisco|pancho:francisco|curro:francisco|fred:frederic friedrich|fredi:friedrich|fritz:friedrich|"
        "ginette:genevieve|gene:genevieve|trude:gertrud|gertie:gertrud|gerda:gertrud|gianni:giovanni|vanni:giovanni|beppe:giuseppe|pino:giuseppe|peppe:giuseppe|lupe:guadalupe|lupita:guadalupe|hans:johannes|"
        "hannes:johannes|jo:johannes joseph|heinz:heinrich karl-heinz|heiner:heinrich|henry:heinrich|nacho:ignacio|inge:ingrid|jim:james|jimmy:james|jamie:james|jenny:jennifer|jen:jennifer|joe:joseph|joey:joseph|"
        "pepe:jose|chepe:jose|kathi:katharina katherine|kathy:katherine katharina|kate:katherine katharina|katie:katherine|kat:katharina katherine|kati:katharina|gigi:luigi|gino:luigi|lucy:lucia|lena:magdalena anna-lena|"
        "leni:magdalena|magda:magdalena|maggie:margaret|peggy:margaret|meg:margaret|marge:margaret|matt:matthias|hias:matthias|matze:matthias|max:maximilian|mike:michael|mick:michael|michi:michael|moni:monica|"
        "nick:nicholas|nico:nicholas|nicky:nicholas|pat:patricia|trish:patricia|patty:patricia|becky:rebecca|becca:rebecca|sam:samuel|sammy:samuel|basti:sebastian|seb:sebastian|wasti:sebastian|sue:susan|susie:susan|"
        "suzy:susan|tom:thomas|tommy:thomas|uschi:ursula|ulla:ursula|vicky:victoria|vic:victoria|yvi:yvonne|jorgi:jorg|gunni:gunther|jurgi:jurgen|camillo:camille|kalle:karl-heinz|karl:karl-heinz|peter:hans-peter|"
        "anna:anna-lena|marie:marie-claire|luc:jean-luc|jean:jean-luc|rafa:raul|zoe:zoe".split("|")
    )
}
_CAMEL = re.compile(r"(?<=[^\W\d_A-ZÀ-Þ])(?=[A-ZÀ-ÞА-Я][^\W\d_A-ZÀ-Þ])")
_LETTERS = re.compile(r"[^\W\d_]+")
_DOTTED = re.compile(r"\b(?:[^\W\d_]\.\s?){2,}", re.UNICODE)


def name_tokens(kind: str, text: str | None) -> list[str]:
    """The tokens of a name in one form: without titles, legal forms and joiners, hyphenated names in parts."""
    plain = skeleton(text or "")
    if kind != "ORG":
        flat = fold(_CAMEL.sub(" ", plain))
        tokens = _LETTERS.findall(flat)
        kept = [t for t in tokens if t not in TITLES or (len(t) == 1)]
        return kept or tokens
    flat = fold(_DOTTED.sub(lambda m: m[0].replace(".", "").replace(" ", "") + " ", _CAMEL.sub(" ", plain) if not plain.isupper() else plain))
    for phrase in LEGAL_PHRASES:
        flat = flat.replace(phrase, " ")
    flat = re.sub(r"\bg ?m ?b ?h\b|\bs ?r ?l\b", " ", flat)
    tokens = _LETTERS.findall(flat)
    kept = [t for t in tokens if t not in LEGAL_FORMS and t not in JOINERS]
    return kept or tokens


def _forms(familiar: Mapping[str, frozenset[str]]) -> Callable[[str], frozenset[str]]:
    """A name's formal forms, itself included."""
    return lambda name: familiar.get(name, frozenset()) | {name}


def _close(a: str, b: str) -> bool:
    if a == b:
        return True
    n = min(len(a), len(b))
    if n < EDITS_FROM:
        return False
    most = 2 if n >= TWO_EDITS_FROM else 1
    return edits(a, b, most) <= most


def same_first(a: Sequence[str], b: Sequence[str], familiar: Mapping[str, frozenset[str]] = FAMILIAR) -> bool:
    """Are these first names (tokens in order) forms of one name? Later names may be left out."""
    _formal = _forms(familiar)
    whole_a, whole_b = "-".join(a), "-".join(b)
    if _formal(whole_a) & _formal(whole_b) or any(_formal(x) & _formal(whole_b) for x in a[:1]) or any(_formal(whole_a) & _formal(x) for x in b[:1]):
        return True
    short, long = sorted((list(a), list(b)), key=len)
    if _close("".join(a), "".join(b)):
        return True
    for x in short:
        hit = next((y for y in long if _close(x, y) or _formal(x) & _formal(y)), None)
        if hit is None:
            return False
        long.remove(hit)
    return True


STRONG, WEAK = "strong", "weak"


def judge_person(a: Sequence[str], wa: Sequence[float], b: Sequence[str], wb: Sequence[float], familiar: Mapping[str, frozenset[str]] = FAMILIAR) -> str | None:
    """``strong``: same family name and first name; ``weak``: the first name is an initial or missing on one side."""
    if "".join(a) == "".join(b):
        return STRONG
    _formal = _forms(familiar)
    sides = []
    for tokens, weights in ((a, wa), (b, wb)):
        full = [(w, t) for t, w in zip(tokens, weights, strict=True) if len(t) > 1 and t not in PARTICLES]
        if not full:
            return None
        sides.append((full, [t for t in tokens if len(t) == 1]))
    (fa, ia), (fb, ib) = sides
    # the family name: the rarest pair of tokens that match, which must be the rarest of one side at least
    pairs = [(min(x, y), s, t) for x, s in fa for y, t in fb if _close(s, t) and len(s) > 3]
    if not pairs:
        joined_a, joined_b = "".join(t for _, t in fa), "".join(t for _, t in fb)
        return STRONG if len(joined_a) > 7 and _close(joined_a, joined_b) else None
    weight, s, t = max(pairs)
    if s != max(fa)[1] and t != max(fb)[1]:
        return None
    ra, rb = [x for _, x in fa if x != s], [x for _, x in fb if x != t]
    if ra and rb:
        return STRONG if same_first(ra, rb, familiar) or same_first(ra[::-1], rb, familiar) else None
    if not ra and not rb:
        return STRONG if sorted(ia) == sorted(ib) or (ia and ib and ia[0] == ib[0]) else (WEAK if not ia or not ib else None)
    names, initials = (ra, ib) if ra else (rb, ia)
    if initials:
        starts = {x[0] for n in names for x in _formal(n)}
        return WEAK if initials[0] in {x[0] for x in _formal("-".join(names)) | _formal(names[0]) | _formal(names[-1])} and all(i in starts for i in initials[1 : len(names)]) else None
    return WEAK


def person_signs(tokens: Sequence[str], weights: Sequence[float], familiar: Mapping[str, frozenset[str]] = FAMILIAR) -> tuple[list[str], list[str]]:
    """Signs of a family name with a first name: those with the rarest token as family name, and those with any.

    Two names that ``judge_person`` accepts for a family name spelt alike share one of the first's own with any of the other's, or the
    other way round. A first name counts in all its forms, by its letter to meet initials, and as a dot alone to meet none.
    """
    _formal = _forms(familiar)
    full = [(w, t) for t, w in zip(tokens, weights, strict=True) if len(t) > 1 and t not in PARTICLES]
    initials = [t for t in tokens if len(t) == 1]
    own: set[str] = set()
    every: set[str] = set()
    for family in {t for _, t in full if len(t) > 3}:
        rest = [t for _, t in full if t != family]
        if rest:
            mine = {form for x in [*rest, *(by.join(o) for by in ("-", "") for o in (rest, rest[::-1]))] for form in _formal(x)}
            theirs = mine | {"."} | {f".{x[0]}" for x in _formal("-".join(rest)) | _formal(rest[0]) | _formal(rest[-1])}
        else:
            mine, theirs = {f".{i}" for i in initials[:1]} or {"."}, {".", *(f".{i}" for i in initials)}
        every.update(f"{family}|{x}" for x in theirs)
        if family == max(full)[1]:
            own.update(f"{family}|{x}" for x in mine)
    return sorted(own), sorted(every)


def _token_match(x: str, y: str) -> float:
    if x == y:
        return 1.0
    if _close(x, y):
        return 0.95
    short, long = sorted((x, y), key=len)
    if len(short) > 1 and len(long) > len(short) + 1 and short[0] == long[0]:  # an abbreviation keeps the order of letters
        letters = iter(long)
        if all(ch in letters for ch in short):
            return 0.9
    return 0.0


def judge_org(a: Sequence[str], wa: Sequence[float], b: Sequence[str], wb: Sequence[float]) -> str | None:
    """``strong`` if the weighted share of matching tokens, in any order, reaches ``SIMILARITY``."""
    if "".join(a) == "".join(b):
        return STRONG
    left, right = list(zip(a, wa, strict=True)), list(zip(b, wb, strict=True))
    total = sum(wa) + sum(wb)
    got, rare = 0.0, max(max(wa), max(wb))
    options = sorted(((_token_match(x, y), w + v, i, j) for i, (x, w) in enumerate(left) for j, (y, v) in enumerate(right)), reverse=True)
    used_a: set[int] = set()
    used_b: set[int] = set()
    rare_met = False
    for match, weight, i, j in options:
        if match and i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            got += match * weight
            rare_met |= match >= 0.95 and max(left[i][1], right[j][1]) >= 0.6 * rare
    for mine, other, used, taken in ((left, right, used_a, used_b), (right, left, used_b, used_a)):  # initials of a run of tokens
        for i, (x, w) in enumerate(mine):
            if i not in used and 2 <= len(x) <= 4:
                free = [j for j in range(len(other)) if j not in taken]
                for k in range(len(free) - len(x) + 1):
                    run = free[k : k + len(x)]
                    if [other[j][0][0] for j in run] == list(x) and run[-1] - run[0] == len(x) - 1:
                        used.add(i)
                        taken.update(run)
                        got += 0.9 * (w + sum(other[j][1] for j in run))
                        break
    return STRONG if rare_met and got >= SIMILARITY * total else None


@once
@F.arrow_udf(T.ArrayType(T.StringType()))
def _tokens_arrow(kinds: pa.Array, texts: pa.Array) -> pa.Array:
    return pa.array([name_tokens(k, t) for k, t in zip(kinds.to_pylist(), texts.to_pylist(), strict=True)], pa.list_(pa.string()))


def rarest_tokens(kind: str, tokens: Sequence[str], weights: Sequence[float], familiar: Mapping[str, frozenset[str]] = FAMILIAR) -> list[str]:
    """The rarest tokens, until what is left weighs less than the similarity asks for."""
    both = list(zip(tokens, weights, strict=True))
    # short tokens are abbreviations and the like, familiar forms stand for others
    both = [(t, w) for t, w in both if len(t) >= GRAMS_FROM and not (kind == "PERSON" and t in familiar)] or both
    total = 0.0
    for _, w in both:
        total += w
    seen, kept = 0.0, []
    for t, w in sorted(both, key=lambda x: (-x[1], x[0])):
        if total - seen < SIMILARITY * total:
            break
        seen += w
        kept.append(t)
    return kept


_ARROW_SIGNS = pa.struct([(c, pa.list_(pa.string())) for c in ("rare", "own", "every")])


def _signs_of(familiar: Mapping[str, frozenset[str]]):
    @once
    @F.arrow_udf(T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("rare", "own", "every")]))
    def signs(kinds: pa.Array, tokens: pa.Array, weights: pa.Array) -> pa.Array:
        rows = []
        for k, t, w in zip(kinds.to_pylist(), tokens.to_pylist(), weights.to_pylist(), strict=True):
            own, every = person_signs(t, w, familiar) if k != "ORG" else ([], [])
            rows.append({"rare": [*dict.fromkeys(rarest_tokens(k, t, w, familiar))], "own": own, "every": [f"={''.join(t)}", *every]})
        return pa.array(rows, _ARROW_SIGNS)

    return signs


def _judge_of(familiar: Mapping[str, frozenset[str]]):
    @once
    @F.arrow_udf(T.StringType())
    def judge(kinds: pa.Array, a: pa.Array, wa: pa.Array, b: pa.Array, wb: pa.Array) -> pa.Array:
        left, right = (zip(t.to_pylist(), w.to_pylist(), strict=True) for t, w in ((a, wa), (b, wb)))
        rows = [(k, *sorted(sides)) for k, *sides in zip(kinds.to_pylist(), left, right, strict=True)]  # in one order, however they are numbered
        return pa.array([judge_org(*x, *y) if k == "ORG" else judge_person(*x, *y, familiar) for k, x, y in rows], pa.string())

    return judge


@once
@F.arrow_udf(T.BooleanType())
def _close_arrow(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_close(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())


def qgrams(token: Column) -> Column:
    """The q-grams of a token as structs of position and text, its ends marked."""
    marked = F.concat(F.lit("^"), token, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(marked) - (Q - 1)), lambda i: F.struct(F.substring(marked, i, F.lit(Q)).alias("gram"), i.alias("at")))


def deletions(token: Column) -> Column:
    """A token, and what is left of it without one letter, and without two where it is long enough for two edits."""
    left = lambda *cuts: F.concat(*[F.substring(token, a, n) for a, n in cuts])
    size, rest = F.length(token), F.lit(DELETED_UP_TO)
    places = F.sequence(F.lit(1), size)
    one = F.transform(places, lambda i: left((F.lit(1), i - 1), (i + 1, rest)))
    two = F.flatten(F.transform(places, lambda i: F.transform(F.slice(places, i + 1, size), lambda j: left((F.lit(1), i - 1), (i + 1, j - i - 1), (j + 1, rest)))))
    return F.concat(F.array(token), one, F.when(size >= TWO_EDITS_FROM, two).otherwise(F.array().cast("array<string>")))


def _gram_signs(tokens: DataFrame) -> DataFrame:
    """(sign, no) of tokens longer than those that ``deletions`` serves: pairs of their rarest q-grams.

    Two tokens of n q-grams at most share n - (Q + 1) * edits of them, which is two at least; so two of the first (Q + 1) * edits + 2 of either, in order
    of rarity, are the same.
    """
    listed = tokens.select("no", "kind", qgrams(F.col("token")).alias("gs"))
    # a q-gram that occurs again is another one
    numbered = F.transform("gs", lambda g, i: F.struct(F.concat(g.gram, F.size(F.filter(F.slice("gs", 1, i), lambda h: h.gram == g.gram)).cast("string")).alias("gram"), g["at"].alias("at")))
    grams = listed.select("no", "kind", F.explode(numbered).alias("g")).select("no", "kind", "g.*")
    counts = grams.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.array_sort(F.collect_list(F.struct("n", "gram", "at")))
    ranked = grams.join(counts, ["kind", "gram"]).groupBy("no", "kind").agg(rarest.alias("grams")).select("no", "kind", F.slice("grams", 1, (Q + 1) * 2 + 2).alias("prefix"))
    # pairs in the order of the token, which edits of other q-grams leave as it is
    ordered = F.array_sort("prefix", lambda x, y: x["at"] - y["at"])
    both = F.flatten(F.transform(ordered, lambda g, i: F.transform(F.slice(ordered, i + 2, F.size(ordered)), lambda h: F.concat(g.gram, h.gram))))
    return ranked.select(F.explode(F.array_distinct(F.transform(both, lambda s: F.xxhash64("kind", F.lit("+"), s)))).alias("sign"), "no")


def token_signs(tokens: DataFrame) -> DataFrame:
    """(sign, no) of (no, kind, token) rows; tokens within the edits that ``_close`` allows share a sign.

    Each edit, a swap of neighbours too, is undone by taking a letter from either side or from both; so close tokens leave the same without as
    many letters as edits, which hardly any others do. Signs are hashes, as what meets is verified.
    """
    size = F.length("token")
    left = F.array_distinct(F.transform(deletions(F.col("token")), lambda t: F.xxhash64("kind", t)))
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small table of tokens has many signs
    # lengths differ by two at most: any two close tokens are both in the first part or both in the second
    signs = tokens.where(size.between(EDITS_FROM, DELETED_UP_TO)).repartition(parts).select(F.explode(left).alias("sign"), "no")
    return signs.unionAll(_gram_signs(tokens.where(size > DELETED_UP_TO - 2)))


def close_tokens(tokens: DataFrame) -> DataFrame:
    """(kind, token, other) of different tokens within the edits that ``_close`` allows, both directions, from distinct (kind, token) rows."""
    numbered = cut(tokens.select(F.monotonically_increasing_id().alias("no"), "kind", "token"))
    signs = cut(token_signs(numbered))
    met = signs.join(signs.select("sign", F.col("no").alias("no_b")), "sign").where("no < no_b").select("no", "no_b").distinct()
    a, b = numbered.alias("a"), numbered.select(F.col("no").alias("no_b"), "kind", "token").alias("b")
    sizes = [F.length(f"{x}.token") for x in "ab"]
    allowed = F.when(F.least(*sizes) >= TWO_EDITS_FROM, 2).otherwise(1)
    # a swap of neighbours is two of the plain edits, and leaves the letters the same
    plain = F.levenshtein(F.col("a.token"), F.col("b.token"), 4)
    letters = [F.array_sort(F.split(f"{x}.token", "")) for x in "ab"]
    swapped = (plain > allowed) & (plain <= 2 * allowed) & F.when(plain == 2 * allowed, letters[0] == letters[1]).otherwise(F.size(F.array_except(*letters)) <= 1)
    likely = (F.col("a.kind") == F.col("b.kind")) & (plain.between(0, allowed) | swapped)
    pairs = cut(met.join(a, "no").join(b, "no_b").where(likely).select("a.kind", F.col("a.token").alias("token"), F.col("b.token").alias("other")))
    verified = cut(pairs.where(_close_arrow(F.col("token"), F.col("other"))))
    for done in (pairs, signs, numbered):
        discard(done)
    return verified.unionAll(verified.select("kind", F.col("other").alias("token"), F.col("token").alias("other")))


def _members(values: DataFrame, kind: str, text: str, kinds: Sequence[str], familiar: Mapping[str, frozenset[str]]) -> DataFrame:
    """(kind, text, entity): the entity of every distinct string that has another spelling, as a number that holds for this table only.

    Strings are numbered as they are written; only numbers and hashed signs are shuffled, and tokens looked up at the end.
    """
    distinct = values.select(F.col(kind).alias("kind"), F.col(text).alias("text")).where(F.col("kind").isin(*kinds) & F.col("text").rlike(r"\S")).distinct()
    strings = cut(distinct.select(F.monotonically_increasing_id().alias("id"), "kind", "text", _tokens_arrow(F.col("kind"), F.col("text")).alias("tokens")))
    totals = {r.kind: r.n for r in strings.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a kind
    each = strings.select("id", "kind", F.posexplode("tokens").alias("at", "token"))
    vocabulary = cut(each.select("id", "kind", "token").distinct().groupBy("kind", "token").agg(F.count(F.lit(1)).alias("df")))
    close = close_tokens(vocabulary.select("kind", "token"))
    around = close.join(vocabulary.withColumnRenamed("token", "other"), ["kind", "other"]).groupBy("kind", "token").agg(F.sum("df").alias("more"))
    # a misspelt common word is as common as the word
    commonness = vocabulary.join(around, ["kind", "token"], "left").select("kind", "token", (F.col("df") + F.coalesce("more", F.lit(0))).alias("df"))
    size = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(n))) for k, n in totals.items()], F.lit(1.0))
    weighed = each.join(commonness, ["kind", "token"]).select("id", "kind", F.struct("at", "token", F.log1p(size / F.col("df")).alias("weight")).alias("t"))
    told = cut(weighed.groupBy("id", "kind").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("id", "kind", "ts", F.col("ts.token").alias("tokens"), F.col("ts.weight").alias("weights")))
    named = cut(told.select("id", "kind", _signs_of(familiar)(*map(F.col, ("kind", "tokens", "weights"))).alias("s")).select("id", "kind", "s.*"))
    hashed = lambda sign: F.xxhash64("kind", sign).alias("sign")
    rare = named.select("id", "kind", F.explode("rare").alias("token"))
    own = named.select("id", "kind", F.explode("own").alias("sign")).select("id", "kind", *[F.split_part("sign", F.lit("|"), F.lit(k)).alias(c) for k, c in ((1, "family"), (2, "first"))])
    for part in ("family", "first"):  # and their close spellings
        own = own.unionByName(own.join(close.withColumnRenamed("token", part), ["kind", part]).drop(part).withColumnRenamed("other", part))
    moved = rare.join(close, ["kind", "token"]).select("id", hashed("other")).unionAll(own.select("id", hashed(F.concat_ws("|", "family", "first"))))
    listed = named.select("id", F.explode(F.transform(F.concat("rare", "every"), lambda t: F.xxhash64("kind", t))).alias("sign"))
    moved = moved.unionAll(named.select("id", F.explode(F.transform(F.concat("rare", F.slice("every", 1, 1)), lambda t: F.xxhash64("kind", t))).alias("sign")))
    met = moved.join(listed.withColumnRenamed("id", "id_b"), "sign").where("id <> id_b")
    candidates = met.select(F.least("id", "id_b").alias("id_l"), F.greatest("id", "id_b").alias("id_r")).distinct()
    side = lambda n: told.select(F.col("id").alias(f"id_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in ("kind", "tokens", "weights")])
    looked = candidates.join(side("l"), "id_l").join(side("r"), "id_r").where("kind_l = kind_r")
    judged = cut(looked.select("id_l", "id_r", _judge_of(familiar)(*map(F.col, ("kind_l", "tokens_l", "weights_l", "tokens_r", "weights_r"))).alias("verdict")).where("verdict IS NOT NULL"))
    strong = judged.where(F.col("verdict") == STRONG)
    groups = components(strong.unionAll(judged.where(F.col("verdict") == WEAK).selectExpr("id_l", "id_l AS id_r", "verdict")).unionAll(judged.where(F.col("verdict") == WEAK).selectExpr("id_r AS id_l", "id_r", "verdict")), "id_l", "id_r")
    groups = cut(groups)
    # components of strings without a full first name go to the only component that they fit
    bare = strings.where(F.size(F.filter("tokens", lambda t: (F.length(t) > 1) & ~t.isin(*PARTICLES))) < 2).select("id")
    of = lambda n: groups.select(F.col("node").alias(f"id_{n}"), F.col("component").alias(f"c_{n}"))
    weak = judged.where(F.col("verdict") == WEAK).join(of("l"), "id_l").join(of("r"), "id_r").where("c_l <> c_r").select("id_l", "id_r", "c_l", "c_r")
    both = weak.unionAll(weak.selectExpr("id_r", "id_l", "c_r", "c_l"))
    from_bare = both.join(bare.withColumnRenamed("id", "id_l"), "id_l", "left_semi").join(bare.withColumnRenamed("id", "id_r"), "id_r", "left_anti")
    only = from_bare.groupBy("c_l").agg(F.min("c_r").alias("lo"), F.max("c_r").alias("hi")).where("lo = hi").select(F.col("c_l").alias("component"), F.col("lo").alias("target"))
    final = groups.join(only, "component", "left").select(F.col("node").alias("id"), F.coalesce("target", "component").alias("entity"))
    return strings.select("id", "kind", "text").join(final, "id").select("kind", "text", "entity")


def link(values: DataFrame, kind: str, text: str, kinds: Sequence[str] = ("PERSON", "ORG"), familiar: Mapping[str, frozenset[str]] = FAMILIAR) -> DataFrame:
    """(kind, text, entity): the entity of every distinct string that has another spelling; entity is the smallest 128-bit id of its strings.

    ``familiar`` has the names that a familiar form stands for.
    """
    member = cut(_members(values, kind, text, kinds, familiar))
    ids = member.groupBy(F.col("entity").alias("no")).agg(F.min(F.md5(F.concat_ws("\x1f", "kind", "text"))).alias("id"))
    return member.join(ids, member.entity == ids.no).select("kind", "text", F.col("id").alias("entity"))


def variant_pairs(values: DataFrame, kind: str, text: str, kinds: Sequence[str] = ("PERSON", "ORG"), familiar: Mapping[str, frozenset[str]] = FAMILIAR) -> DataFrame:
    """(kind, text_a, text_b) with text_a < text_b: every pair of different strings of one entity."""
    member = cut(_members(values, kind, text, kinds, familiar))
    a, b = member.alias("a"), member.alias("b")
    pairs = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.text") < F.col("b.text")))
    return pairs.select(F.col("a.kind").alias("kind"), F.col("a.text").alias("text_a"), F.col("b.text").alias("text_b"))
