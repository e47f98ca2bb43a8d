"""Personal data and secrets by aggregation of weak labelers, in built-in functions only.

Base patterns (email, ip, card, phone) with their checks always give spans. Further candidates (local
phone numbers, social handles, account and identity numbers, persons after a title, secrets, street
addresses) and base matches that fail their check are voted on, as base spans are, by regex, gazetteer and
context labelers: for, against or abstaining. The distinct vote patterns with their counts are all that
expectation-maximisation needs: it estimates each labeler's reliability and a probability for each pattern.
These train the final span classifier, a naive Bayes over span features, which decides on the further
candidates; failed base matches only teach it. Matches get positions by marking them in the text and
splitting there, so offsets are code points; nothing leaves the JVM but the pattern counts, whose number
is bounded. Candidates are stored, so the patterns run once over the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, stored

OPEN, CLOSE, OTHER = "", "", "�"
#: Characters of context on either side.
CONTEXT = 24
#: Kinds in the order of spans that start together. Repeats are possessive where nothing follows that
#: could be given back, and a run is entered at its start only (or where the last match ended), so time
#: is linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FURTHER = {
    "local_phone": r"(?<![0-9+().-])(?<![0-9+] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "handle": r"(?<![A-Za-z0-9._%+@/-])@[A-Za-z][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_@.])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-z]{2,20}(?: [A-Z][a-z]{2,20})?",
    "secret": r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=@.-])",
    "address": r"(?<![A-Za-z0-9])[0-9]{1,5} (?:[A-Z][a-z]{2,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Way)(?![A-Za-z])",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "local_phone": r"[0-9]{3}[ .-][0-9]{4}", "handle": "@[A-Za-z]", "account": "[A-Z]{2}[0-9]{2}", "identity": "-[0-9]{2}-", "person": r"(?:r|s|f|u|me|a)\.? [A-Z]", "secret": "[A-Za-z0-9+/_-]{16}", "address": "[0-9] [A-Z][a-z]{2}"}
KINDS = [*BASE, *FURTHER]
#: Gazetteers: top domains, country codes of numbers, first digits of cards, countries of accounts, words that name secrets.
DOMAINS = "com|org|net|edu|gov|info|io|example|de|fr|es|uk|eu"
CALLING = r"\+(?:1|7|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?![0-9]{14})"
ACCOUNTS = "^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE)"
SECRETS = r"(?i)(?:token|key|secret|passwd|password|pwd|credentials?|auth|bearer|signature)['\"]?\s{0,3}(?:[:=]|is)?\s{0,3}['\"]?$"
PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xox[abp]-|eyJ)"
#: Context: words that announce personal data, words of other numbers.
CUES = r"(?i)(?:e-?mail|mail|contact|tel|phone|fon|call|mobile|fax|ip|host|card|visa|iban|account|konto|compte|cuenta|ssn|social|id|name|user|signed|from|token|key|secret|password|address|lives at)(?: (?:me|us|at|is|number|no))?['\"]?\W{0,4}$"
NOT_CUES = r"(?i)(?:version|v|isbn|doi|no\.|page|art|ref|price|commit|sha1|sha256|md5|checksum|http\S*|www\S*|[#$€£/])\W{0,2}$"
LABELERS = ("shape", "check", "gazetteer", "cue", "counter")


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once: what a lambda takes from outside is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _length_sums(lengths: Column) -> Column:
    """Sums of all before each element, by blocks, so that long arrays don't take square time."""
    block, add, zero = F.lit(256), lambda a, x: a + x, F.lit(0)

    def with_lengths(n: Column) -> Column:
        blocks = F.sequence(zero, F.floor((F.size(n) - 1) / block).cast("int"))
        totals = F.transform(blocks, lambda b: F.aggregate(F.slice(n, b * block + 1, block), zero, add))

        def with_starts(before: Column) -> Column:
            return F.transform(n, lambda _, i: F.get(before, F.floor(i / block).cast("int")) + F.aggregate(F.slice(n, F.floor(i / block).cast("int") * block + 1, i % block), zero, add))

        return _bound(_bound(totals, lambda t: F.transform(t, lambda _, b: F.aggregate(F.slice(t, F.lit(1), b), zero, add))), with_starts)

    return _bound(lengths, with_lengths)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _checked(kind: str, value: Column) -> Column:
    """The kind's own test of a match."""
    digits = _digits(value)
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda x: ~F.regexp_replace(x, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "local_phone":
        return ~digits.rlike("^(?:[01]|.{3}[01])")
    if kind == "identity":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":  # letters and digits in many kinds, as chance would have it
        return F.size(F.array_distinct(F.split(value, ""))) >= F.least(F.lit(11), F.length(value) / 2)
    return F.lit(True)


#: Base matches that teach the classifier though they fail: they must look like the kind at least.
FAILING = {"ip": "^[0-9.]{7,20}$", "card": "^(?:[0-9][ -]?){11,18}[0-9]$", "phone": r"^\+(?:[^0-9]*[0-9]){7,18}[^0-9]*$"}
#: Shapes that speak for a kind, and those that speak against it.
SHAPES = {
    "email": (r"^[a-z0-9]+(?:[._+-][a-z0-9]+)*@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,10}$", r"^[._%+-]|\.\.|\.[0-9]+$"),
    "ip": (r"^[1-9][0-9]{0,2}(?:\.[0-9]{1,3}){3}$", r"^0|\.0[0-9]"),
    "card": (r"^(?:[0-9]{4}([ -]?))(?:[0-9]{4}\1){2}[0-9]{4}$", r"^0|^([0-9])[ -]?(?:\1[ -]?)+$"),
    "phone": (r"^\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$", r"[-.]{2}| {2}"),
    "local_phone": (r"^\(?[0-9]{3}\)? ?[ .-]?[0-9]{3}[.-][0-9]{4}$", "^$"),
    "handle": (r"^@[A-Za-z]+[0-9_]+[A-Za-z0-9_]*$", "^@(?:media|import|property|param|return|override|charset)$"),
    "account": (r"^[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){2,6}", r"^(?:[A-Z0-9]* ?)(?:[A-Z]{4} ?){3}"),
    "identity": ("^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "^$"),
    "person": (r" [A-Z][a-z]+ [A-Z][a-z]+$", "^$"),
    "secret": (r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])[A-Za-z0-9+/_-]{20,100}={0,2})$", r"^(?:[0-9-]+|[A-Za-z/_-]+={0,2}|.{256,})$"),
    "address": (r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Way)$", "^$"),
}
#: What a kind's gazetteer knows: of the match, or of what stands before it.
GAZETTEERS = {"email": rf"\.(?:{DOMAINS})$", "card": "^[3-6]", "phone": f"^{CALLING}", "account": ACCOUNTS, "person": "^(?:Mr|Mrs|Ms|Dr|Prof)", "secret": PREFIXES}


def _matches(clean: Column, kind: str, pattern: str) -> Column:
    """struct(kind, start, end, value, left, right) of all matches."""
    def spans(h: Column) -> Column:
        def span(i: Column) -> Column:
            start, value = F.get(h["at"], i), F.get(h["parts"], i)
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.right(F.get(h["parts"], i - 1), F.lit(CONTEXT)).alias("left"), F.left(F.get(h["parts"], i + 1), F.lit(CONTEXT)).alias("right"))

        return F.when(F.size(h["parts"]) > 2, F.transform(F.sequence(F.lit(1), F.size(h["parts"]) - 2, F.lit(2)), span))

    split = F.split(F.regexp_replace(clean, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]")
    cut = _bound(split, lambda p: F.struct(p.alias("parts"), _length_sums(F.transform(p, lambda x: F.length(x))).alias("at")))
    return _bound(cut, spans)


def _sign(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _voted(kind: str, m: Column) -> Column:
    """A match with each labeler's vote and the classifier's features; ok: it passes the kind's own test."""
    value, left, right = m["value"], m["left"], m["right"]
    digits, size = F.length(_digits(value)), F.length(value)
    ok = _checked(kind, value)
    good, bad = SHAPES[kind]
    gazetteer = _sign(value.rlike(GAZETTEERS[kind]), F.lit(kind in ("email", "card", "phone", "account"))) if kind in GAZETTEERS else F.lit(0)
    if kind == "secret":
        gazetteer = F.when(left.rlike(SECRETS), 1).otherwise(gazetteer)
    counter = _sign(F.lit(False), left.rlike(NOT_CUES) | right.rlike(r"^(?:[%$€£°/=]|\.[0-9])"))
    shares = F.when(digits == 0, 0).when(digits * 2 < size, 1).otherwise(2)
    edge = F.when(left.rlike(r"[\s(\[<,;:'\"=]$") | (left == ""), 0).otherwise(1) + F.when(right.rlike(r"^[\s)\]>,.;:!?'\"]") | (right == ""), 0).otherwise(2)
    votes = {"shape": _sign(value.rlike(good), value.rlike(bad)), "check": _sign(ok, ~ok), "gazetteer": gazetteer, "cue": _sign(left.rlike(CUES), F.lit(False)), "counter": counter}
    features = {"digits": shares, "edge": edge, "length": F.least(F.lit(6), F.floor(F.log2(size + 1.0))).cast("int")}
    return F.struct(*(m[c].alias(c) for c in ("kind", "start", "end")), ok.alias("ok"), *(x.alias(c) for c, x in (votes | features).items()))


def _plausible(kind: str):
    return lambda m: _checked(kind, m["value"]) | m["value"].rlike(FAILING.get(kind, "."))


def _voter(kind: str):
    return lambda m: _voted(kind, m)


def _clear_of(spans: Column, base: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


SPANS = "array<struct<kind:int,start:int,end:int,ok:boolean,shape:int,check:int,gazetteer:int,cue:int,counter:int,digits:int,edge:int,length:int>>"


def with_candidates(docs: DataFrame, base: str, further: str, failed: str, text_col: str = "text") -> DataFrame:
    """Adds three arrays of voted spans: base ones, further candidates clear of them, base matches that fail their test."""
    clean, *names = fresh(docs, "clean", *KINDS)
    out = docs.withColumn(clean, F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + CLOSE, OTHER * 2))
    none, columns = F.array().cast(SPANS), {}
    for name, (kind, pattern) in zip(names, (BASE | FURTHER).items(), strict=True):
        found = _matches(F.col(clean), kind, pattern)
        if kind == "secret":
            found = F.filter(found, lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
        elif kind in BASE:
            found = F.filter(found, _plausible(kind))
        columns[name] = F.when(F.col(clean).rlike(NEEDS[kind]), F.coalesce(F.transform(found, _voter(kind)).cast(SPANS), none)).otherwise(none)
    every, more = fresh(out, "every", "more")
    out = out.withColumns(columns).withColumn(every, F.concat(*(F.col(c) for c in names[: len(BASE)]))).withColumn(more, F.concat(*(F.col(c) for c in names[len(BASE) :])))
    out = out.withColumn(base, F.filter(every, lambda s: s["ok"])).withColumn(failed, F.filter(every, lambda s: ~s["ok"]))
    return out.withColumn(further, F.when(F.size(more) > 0, _clear_of(F.col(more), F.col(base))).otherwise(F.col(more))).drop(clean, every, more, *names)


FEATURES = ("kind", "shape", "check", "gazetteer", "cue", "counter", "digits", "edge", "length")


def aggregate_votes(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[list[float], dict[str, dict[int, tuple[float, float]]], float]:
    """Expectation-maximisation over (votes, count): probability of each pattern, reliabilities, prior.

    reliabilities: labeler, vote -> (share among personal data, share among the rest).
    """
    total = sum(n for _, n in patterns) or 1.0
    # at first a pattern is as likely as its votes are positive
    p = [min(0.95, max(0.05, 0.5 + sum(v) / (2 * len(LABELERS)))) for v, _ in patterns]
    tables: dict[str, dict[int, tuple[float, float]]] = {}
    prior = 0.5
    for _ in range(rounds):
        yes = sum(q * n for q, (_, n) in zip(p, patterns, strict=True))
        prior = (yes + 1) / (total + 2)
        tables = {}
        for k, name in enumerate(LABELERS):
            tables[name] = {}
            for vote in (-1, 0, 1):
                a = sum(q * n for q, (v, n) in zip(p, patterns, strict=True) if v[k] == vote)
                b = sum((1 - q) * n for q, (v, n) in zip(p, patterns, strict=True) if v[k] == vote)
                # pseudo-counts say that votes for are likelier on personal data, so classes can't swap
                tables[name][vote] = ((a + 1 + vote * 0.9) / (yes + 3), (b + 1 - vote * 0.9) / (total - yes + 3))
        odds = [math.log(prior / (1 - prior)) + sum(math.log(tables[name][v[k]][0] / tables[name][v[k]][1]) for k, name in enumerate(LABELERS)) for v, _ in patterns]
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in odds]
    return p, tables, prior


class SpanClassifier:
    """Naive Bayes over span features; the weights are log odds of feature values."""

    def __init__(self, rows: list[tuple[dict[str, int], tuple[int, ...], float]]):
        """rows: features, votes and count of each distinct combination."""
        votes: dict[tuple[int, ...], float] = {}
        for _, v, n in rows:
            votes[v] = votes.get(v, 0.0) + n
        patterns = sorted(votes.items())
        p, self.reliabilities, self.prior = aggregate_votes(patterns)
        likely = {v: q for (v, _), q in zip(patterns, p, strict=True)}
        total = sum(n for *_, n in rows)
        yes = sum(likely[v] * n for _, v, n in rows)
        self.bias = math.log((yes + 1) / (total - yes + 1))
        self.weights: dict[str, dict[int, float]] = {}
        for name in FEATURES:
            values = sorted({f[name] for f, _, _ in rows})
            self.weights[name] = {}
            for value in values:
                a = sum(likely[v] * n for f, v, n in rows if f[name] == value)
                n = sum(n for f, _, n in rows if f[name] == value)
                share = n / total  # pseudo-counts in proportion, so that a rare value alone says nothing
                self.weights[name][value] = math.log((a + share) / (yes + 1) * (total - yes + 1) / (n - a + share))

    def odds(self, span: Column) -> Column:
        out = F.lit(self.bias)
        for name, weights in self.weights.items():
            chosen = F.lit(0.0)
            for value, w in weights.items():
                chosen = F.when(span[name] == value, F.lit(w)).otherwise(chosen)
            out = out + chosen
        return out


def fit_classifier(candidates: DataFrame, *columns: str) -> SpanClassifier:
    """From the counts of distinct votes and features over all spans of the columns; their number is bounded by their values'."""
    span = candidates.select(F.explode(F.concat(*columns)).alias("s")).select("s.*")
    names = list(dict.fromkeys([*FEATURES, *LABELERS]))
    rows = span.groupBy(*names).agg(F.count("*").alias("_n")).collect()
    return SpanClassifier([({k: r[k] for k in FEATURES}, tuple(r[k] for k in LABELERS), float(r["_n"])) for r in rows])


def find_spans(docs: DataFrame, text_col: str = "text", base_col: str = "base_spans", spans_col: str = "spans", keep_text: bool = True) -> DataFrame:
    """Adds base_spans and spans (base and further): arrays of struct(start, kind, end), in order; kind is its place in KINDS.

    start and end are code points, end exclusive. A null or empty text has none; rows stay as they are, repeated or not, and
    an empty table stays empty. Columns of docs that are called like the two added ones are replaced, all others stay;
    without keep_text the text goes. Spans that start together are in the order of KINDS, equal ones stay each.
    """
    base, further, failed = fresh(docs, "base", "further", "failed")
    found = with_candidates(docs, base, further, failed, text_col)
    found = stored(found if keep_text else found.drop(text_col), "pii")
    model = fit_classifier(found, base, further, failed)
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    more = F.filter(further, lambda s: model.odds(s) > 0)
    b, s = F.array_sort(plain(F.col(base))), F.array_sort(F.concat(plain(F.col(base)), plain(more)))
    return found.withColumns({base_col: b, spans_col: s}).drop(base, further, failed)


def is_kind(kind: str):
    return lambda k: k == KINDS.index(kind)


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first gives the kind."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def replaced(found: Column) -> Column:
        def piece(reach: Column):
            def one(s: Column, i: Column) -> Column:
                behind = F.get(reach, i)
                return F.when(s["start"] >= behind, F.concat(F.substring(text, behind + 1, s["start"] - behind), F.get(names, s["kind"]))).otherwise(F.lit(""))

            return one

        ends = F.transform(found, lambda s: s["end"])
        reach = _bound(ends, lambda e: F.transform(e, lambda _, i: F.coalesce(F.array_max(F.slice(e, F.lit(1), i)), F.lit(0))))
        pieces = _bound(reach, lambda r: F.transform(found, piece(r)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _bound(spans, replaced)).otherwise(text)
