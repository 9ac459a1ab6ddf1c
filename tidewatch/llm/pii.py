"""PII surrogates: detected entities are replaced by keyed ones of the same kind and form, in DataFrame functions only.

Entities are found by one pattern: e-mail and IPv4 addresses, phone, card, social security and account numbers, secrets
(access keys, values after words such as token or password in any case, hexadecimal strings of 32 digits or more), given names, and family names after
a given name or a title. Names outside the list of given names are found by what stands beside them: a label such as "Name:" or "Contact:", or
an e-mail address in angle brackets. An entity is normalised, so that other spellings of it corefer (case of an address or of a name, separators of
a number, case of a long hexadecimal string). The surrogate of a normalised entity comes from a keyed hash and keeps its form: character classes, length and
separators; the provider's letter, the top-level domain and a secret's prefix; valid check digits of cards and accounts;
given names stay in their gender and script, other names in the script of each letter, whole upper case stays so.

A second pass looks for the names that were found in a text all over that text, one list a text, and gives their lone
mentions ("Anna said", a lone family name) the same surrogates. Mentions begin with a capital and are compared without case
and without a genitive end; names that a text never shows beside such evidence are not found.

Distinctness is checked over the whole corpus: a candidate that another entity of the kind has too, or that is itself an
entity of the corpus, is drawn again with the next attempt number until none is left. After every ``TRIES`` attempts the form is
widened by a character, so that short forms (there are 676 names of two letters) never run out. The assignment depends on the key
and on the set of entities only. Given names are permuted inside their list, so they need no check against each other.

Texts without an entity pass by unshuffled. For the others, one row per distinct text and entity is joined with the
assignment and the finished list is joined back by the text's hash.

Defined cases: null and empty texts stay as they are, with no entities; texts of any length are read whole; repeated rows
get equal results; rows without id are treated like others; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import free_name, table
from tidewatch.session import cut_lineage

# Common given names by gender and script, titles, words before a secret.
GIVEN = {
    "female_latin": ("Anna", "Carmen", "Charlotte", "Elena", "Emma", "Hannah", "Isabel", "Julia", "Laura", "Lucía", "Maria", "Marie", "Mary", "Olivia", "Sarah", "Sophie"),
    "male_latin": ("Andreas", "Carlos", "David", "Jack", "James", "Jean", "John", "José", "Karl", "Louis", "Martin", "Michael", "Paul", "Pierre", "Robert", "Thomas"),
    "female_cyrillic": ("Анна", "Елена", "Мария", "Наталья", "Ольга", "Татьяна"),
    "male_cyrillic": ("Александр", "Дмитрий", "Иван", "Михаил", "Павел", "Сергей"),
}
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Mme", "Sr", "Sra", "Señor", "Señora")
SECRET_WORDS = ("api_key", "apikey", "passwd", "password", "pwd", "secret", "token")
SECRET_PREFIXES = ("AKIA", "ghp_", "sk-")
NAME_LABELS = ("name", "full name", "contact", "author", "patient", "customer", "employee", "applicant", "signed", "signed by", "attn")
# End of the fixed values.

_NAMES = "|".join(n for names in GIVEN.values() for n in names)
_ASSIGNED = rf"(?i:{'|'.join(SECRET_WORDS)})\s{{0,3}}[=:]\s{{0,3}}[\x22']?"
_FAMILY = r"\p{Lu}[\p{L}'-]+(?!\p{L})"
_HEX = "[0-9a-fA-F]"
_CALLED = rf"(?:{'|'.join(TITLES)})\.? "
_LABEL = rf"(?i:{'|'.join(NAME_LABELS)}):[ \t]{{0,3}}"
_TWO = rf"{_FAMILY}(?: {_FAMILY}){{1,2}}"
#: Attempts in a form before it is widened by one more character.
TRIES = 4
#: All begin where no word character goes before; the cheap look at the first character comes first.
_PATTERNS = {
    "secret": rf"(?:AKIA[0-9A-Z]{{16}}|ghp_[A-Za-z0-9]{{20,}}|sk-[A-Za-z0-9]{{20,}}|(?={_HEX}{{32}}){_HEX}{{32,}}+)(?![A-Za-z0-9])",
    "assigned": rf"{_ASSIGNED}[\w+/=-]{{6,}}",
    "email": r"\w[\w.%+-]{0,63}+@[\w-]{1,63}+(?:\.[\w-]{1,63}+)+",
    "ipv4": r"(?=[0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])",
    "iban": r"(?=[A-Z]{2}[0-9]{2})[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?=[0-9]{4})[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?!\w)",
    "ssn": r"(?=[0-9]{3}-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?=[+(0-9])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w))",
    "name": rf"(?=\p{{Lu}})(?:(?:{_NAMES}) (?!(?:{_NAMES})\b){_FAMILY}|{_CALLED}(?:(?:{_NAMES}) )?{_FAMILY}|(?:{_NAMES})(?= \p{{Lu}})|{_TWO}(?= ?<[\w.%+-]{{1,64}}+@))",
    "labelled": rf"{_LABEL}{_TWO}",
}
#: What may be a lone mention of a name, and the end that is not part of a name.
_LONE = r"(?<![\w\p{L}])\p{Lu}[\p{L}'-]++(?!\w)"
_TAIL = r"(?:'s|['-])+$"
PATTERN = rf"(?<![\w\p{{L}}])(?:{'|'.join(_PATTERNS.values())})"


def _is_name(span: Column) -> Column:
    """Whether a found string is a name: what comes before and after it is not part of it."""
    return span.rlike(rf"^(?:{_LABEL})?(?:{_CALLED})?(?:{_NAMES}|{_FAMILY})(?: {_FAMILY}){{0,2}}$")


def _core(e: Column) -> Column:
    return F.regexp_replace(e, _TAIL, "")


def _tail(e: Column) -> Column:
    return F.regexp_extract(e, _TAIL, 0)


def _parts(e: Column) -> Column:
    """A found string as (what stays before it, entity) pairs: names and assigned secrets have parts that stay.

    Every word of a name is an entity of its own.
    """
    pair = lambda before, entity: F.struct(before.alias("before"), entity.alias("e"))
    assigned = F.regexp_extract(e, rf"^{_ASSIGNED}", 0)
    title = F.regexp_extract(e, rf"^(?:{_LABEL})?(?:{_CALLED})?", 0)
    named = F.transform(F.split(F.substr(e, F.length(title) + 1), " "), lambda x, i: pair(F.when(i == 0, title).otherwise(" "), x))
    return (
        F.when(e.rlike(rf"^{_ASSIGNED}[\w+/=-]{{6,}}$"), F.array(pair(assigned, F.substr(e, F.length(assigned) + 1))))
        .when(_is_name(e), named).otherwise(F.array(pair(F.lit(""), e)))
    )


def _kind(e: Column) -> Column:
    """Kind of a found string: the first pattern that it fits as a whole."""
    alone = _PATTERNS
    given = reduce(lambda c, g: c.when(e.isin(*GIVEN[g]), f"given_{g}"), GIVEN, F.when(e.isNull(), None))
    for k in ("email", "ipv4"):
        given = given.when(e.rlike(f"^(?:{alone[k]})$"), k)
    given = given.when(e.rlike(r"^(?:AKIA|ghp_|sk-)") | e.rlike(rf"^{_HEX}{{32,}}$"), "secret")
    for k in ("iban", "card", "ssn", "phone"):
        given = given.when(e.rlike(f"^(?:{alone[k]})$"), k)
    return given.when(e.rlike(rf"^{_FAMILY}$"), "family").otherwise("secret")


def _norm(kind: Column, e: Column) -> Column:
    digits = F.regexp_replace(e, "[^0-9]", "")
    return (
        F.when(kind == "phone", F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits)).when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.upper(F.regexp_replace(e, " ", ""))).when(kind == "email", F.lower(e))
        .when((kind == "secret") & e.rlike(rf"^{_HEX}{{32,}}$"), F.lower(e)).when(kind == "family", F.initcap(F.lower(_core(e)))).otherwise(e)
    )


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _drawn(seed: Column, i: Column) -> Column:
    """A number for the i-th place: 16 bits of a keyed hash."""
    block = F.sha2(F.concat(seed, F.lit("/"), F.floor(i / 16).cast("string")), 256)
    return F.conv(F.substr(block, ((i % 16) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Letters that take the place of letters of other scripts with two cases.
ALPHABETS = {"Cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ"}


def _mapped(s: Column, seed: Column, keep: Column, hexadecimal: Column) -> Column:
    """Every letter and digit exchanged inside its class; places where ``keep`` (a function of place) holds stay."""
    def one(c: Column, i: Column) -> Column:
        n = _drawn(seed, i)
        own = reduce(lambda e, script: e.when(c.rlike(rf"\p{{Is{script}}}"), _pick(ALPHABETS[script], n)), ALPHABETS, F.when(hexadecimal, _pick("abcdef", n)))
        low = own.otherwise(_pick(LOWER, n))
        return F.when(keep(i), c).when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike(r"\p{Lu}"), F.upper(low)).when(c.rlike(r"\p{L}"), low).otherwise(c)

    return F.array_join(F.transform(_chars(s), one), "")


def _luhn(body: Column) -> Column:
    """The check digit that makes a card number valid."""
    total = F.aggregate(
        F.transform(F.reverse(_chars(body)), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )
    return ((10 - total % 10) % 10).cast("string")


def _iban_check(country: Column, body: Column) -> Column:
    """The two check digits of an account number, by remainder 97."""
    values = F.transform(_chars(F.concat(body, country, F.lit("00"))), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(values, F.lit(0), lambda a, x: F.when(x < 10, (a * 10 + x) % 97).otherwise((a * 100 + x) % 97).cast("int"))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def candidate(kind: Column, norm: Column, key: str, attempt: Column) -> Column:
    """The surrogate that the key gives a normalised entity in an attempt. What is read of the whole entity is bound once."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 256)
    more = F.floor(attempt / TRIES).cast("int")
    wide = F.when(kind == "email", F.concat(F.repeat(F.lit("a"), more), norm)).when(kind == "family", F.concat(norm, F.repeat(F.lit("a"), more))).otherwise(F.concat(norm, F.repeat(F.lit("0"), more)))
    bound = F.array(F.struct(seed.alias("seed"), norm.rlike(rf"^{_HEX}+$").alias("is_hex"), F.when(more > 0, wide).otherwise(norm).alias("form"), more.alias("more")))
    return F.element_at(F.transform(bound, lambda b: _formed(kind, b["form"], b["seed"], b["is_hex"], b["more"])), 1)


def _formed(kind: Column, norm: Column, seed: Column, is_hex: Column, more: Column) -> Column:
    no, never = F.lit(False), lambda i: F.lit(False)
    top = F.length(norm) - F.length(F.substring_index(norm, ".", -1))
    prefix = reduce(lambda c, p: c.when(norm.startswith(p), len(p)), SECRET_PREFIXES, F.when(no, 0)).otherwise(0)
    body = _mapped(F.substr(norm, F.lit(1), F.length(norm) - 1), seed, lambda i: i == 0, no)
    account = _mapped(F.substr(norm, F.lit(5)), seed, never, no)
    country = F.substring(norm, 1, 2)
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.lit(1) + _drawn(seed, i) % 254).cast("string"))
    family = F.initcap(_mapped(F.lower(norm), seed, never, no))
    return (
        F.when(kind == "email", _mapped(norm, seed, lambda i: i >= top, no)).when(kind == "ipv4", F.concat(F.array_join(octets, "."), F.when(more > 0, F.concat(F.lit(":"), _mapped(F.repeat(F.lit("0"), more), seed, never, no))).otherwise("")))
        .when(kind == "card", F.concat(body, _luhn(body))).when(kind == "iban", F.concat(country, _iban_check(country, account), account))
        .when(kind.isin("ssn", "phone"), _mapped(norm, seed, never, no)).when(kind == "family", family)
        .otherwise(_mapped(norm, seed, lambda i: i < prefix, is_hex))
    )


def _given(kind: Column, norm: Column, key: str) -> Column:
    """A given name of the same gender and script: the next one in the list as ordered by the key."""
    out = F.when(F.lit(False), "")
    for group, names in GIVEN.items():
        ring = F.transform(F.array_sort(F.array(*(F.struct(F.sha2(F.lit(f"{key}|{n}"), 256).alias("h"), F.lit(n).alias("n")) for n in names))), lambda x: x["n"])
        at = F.array_position(ring, norm)
        out = out.when(kind == f"given_{group}", F.element_at(ring, (at % len(names) + 1).cast("int")))
    return out


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Surrogates of distinct ``(kind, norm)``: no two alike in a kind, none of them an entity of the corpus."""
    named = entities.where(F.col("kind").startswith("given")).withColumn("surrogate", _given(F.col("kind"), F.col("norm"), key))
    todo = entities.where(~F.col("kind").startswith("given")).withColumn("attempt", F.lit(0))
    real = todo.select("kind", F.col("norm").alias("surrogate"))
    done = None
    while True:
        drawn = cut_lineage(todo.withColumn("surrogate", candidate(F.col("kind"), F.col("norm"), key, F.col("attempt"))), "surrogates")
        taken = real if done is None else real.unionByName(done.select("kind", "surrogate"))
        first = drawn.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        good = cut_lineage(first.select("kind", "norm", "surrogate"), "assigned")
        done = good if done is None else done.unionByName(good)
        todo = cut_lineage(drawn.join(good, ["kind", "norm"], "left_anti").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), "again")
        if todo.isEmpty():
            return done.unionByName(named.select("kind", "norm", "surrogate"))


def _rendered(kind: Column, surface: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of the found string: its separators, leading digits and upper case. What a widened one has more comes first."""
    chars = F.reverse(_chars(surrogate))
    marks = F.reverse(_chars(surface))
    place = lambda i: F.size(F.filter(F.slice(marks, 1, i + 1), lambda c: c.rlike("[0-9A-Za-z]"))) - 1
    filled = F.transform(marks, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.coalesce(F.get(chars, place(i)), c)).otherwise(c))
    left = F.slice(chars, F.size(F.filter(marks, lambda c: c.rlike("[0-9A-Za-z]"))) + 1, F.greatest(F.size(chars), F.lit(1)))
    shout = (F.length(_core(surface)) > 1) & (F.upper(_core(surface)) == _core(surface))
    same = F.transform(F.arrays_zip(_chars(surface).alias("a"), _chars(surrogate).alias("b")), lambda x: F.when(x["a"].rlike(r"\p{Lu}"), F.upper(x["b"])).otherwise(F.coalesce(x["b"], F.lit(""))))
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), F.concat(F.array_join(F.reverse(left), ""), F.array_join(F.reverse(filled), "")))
        .when((kind == "email") | ((kind == "secret") & surface.rlike(rf"^{_HEX}{{32,}}$")), F.array_join(same, ""))
        .when(kind == "family", F.concat(F.when(shout, F.upper(surrogate)).otherwise(surrogate), _tail(surface))).otherwise(surrogate)
    )


def _place(names: Column, word: Column) -> Column:
    """Place of a word in a sorted list, or null, by halving it."""
    state = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halved(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        left = F.get(names, mid) > word
        return F.when(s["lo"] >= s["hi"], s).otherwise(state(F.when(left, s["lo"]).otherwise(mid + 1), F.when(left, mid).otherwise(s["hi"])))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(names))) + 1)
    after = F.aggregate(steps, state(F.lit(0), F.size(names)), halved)["lo"]
    return F.when(F.get(names, after - 1) == word, after - 1)


def _folded(word: Column) -> Column:
    return F.initcap(F.lower(_core(word)))


def _lone(gap: Column, names: Column, surrogates: Column) -> Column:
    """Text between entities with the lone mentions of names replaced."""
    words = F.regexp_extract_all(gap, F.lit(_LONE), F.lit(0))

    def one(x: Column) -> Column:
        word = F.coalesce(x["w"], F.lit(""))
        core = _core(word)
        new = F.get(surrogates, _place(names, _folded(word)))
        new = F.when((F.length(core) > 1) & (F.upper(core) == core), F.upper(new)).otherwise(new)
        return F.concat(x["g"], F.when(word == "", "").otherwise(F.concat(F.coalesce(new, core), _tail(word))))

    return F.array_join(F.transform(F.arrays_zip(F.split(gap, _LONE, -1).alias("g"), words.alias("w")), one), "")


def replace_entities(docs: DataFrame, key: str, text: str = "text", n_entities: str | None = None) -> DataFrame:
    """Documents with every entity replaced, and the number of entities under the name given."""
    mark, own, new, names, others, parts = (free_name(docs, x) for x in ("mark", "key", "new", "names", "others", "parts"))
    has = F.coalesce(F.col(text).rlike(PATTERN), F.lit(False))
    found = docs.where(has).select(F.col(text).alias("t")).select(F.md5("t").alias("k"), F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0)).alias("all"))
    each = found.groupBy("k").agg(F.first("all").alias("all")).select("k", F.posexplode("all").alias("i", "span"))
    each = each.select("k", "i", _is_name(F.col("span")).alias("named"), F.posexplode(_parts(F.col("span"))).alias("j", "x")).select("k", "i", "j", "named", "x.before", "x.e")
    each = cut_lineage(each.withColumn("kind", _kind(F.col("e"))).withColumn("norm", _norm(F.col("kind"), F.col("e"))), "entities")
    pairs = assign(each.select("kind", "norm").distinct(), key)
    shown = F.concat("before", _rendered(F.col("kind"), F.col("e"), F.col("surrogate")))
    # Of a word that is a given and a family name, the last entry counts: the given name.
    name = F.when(F.col("named"), F.struct(F.initcap(F.lower("norm")).alias("name"), "kind", "surrogate"))
    ready = each.join(pairs, ["kind", "norm"]).select("k", "i", F.struct("j", shown.alias("s")).alias("x"), name.alias("name"))
    # One string a found span; a text has every span once, so the list of spans is in the order of their places.
    spans = ready.groupBy("k", "i").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]), "").alias("s"), F.collect_set("name").alias("names"), F.count(F.lit(1)).alias("n"))
    lists = spans.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias(new), F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.sum("n").alias(parts))
    lists = lists.select(F.col("k").alias(own), F.col(f"{new}.s").alias(new), F.col("names.name").alias(names), F.col("names.surrogate").alias(others), parts)
    hit = docs.where(has).withColumn(mark, F.md5(F.col(text))).join(lists, F.col(mark) == F.col(own))
    gaps = F.split(F.col(text), PATTERN, -1)
    here = lambda i: F.coalesce(F.get(new, i), F.lit(""))
    known = F.size(names) > 0
    lone = lambda g: F.when(known, _lone(g, F.col(names), F.col(others))).otherwise(g)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(lone(g), here(i))), "")
    again = lambda g: F.size(F.filter(F.regexp_extract_all(g, F.lit(_LONE), F.lit(0)), lambda w: _place(F.col(names), _folded(w)).isNotNull()))
    mentions = F.when(known, F.aggregate(F.transform(gaps, again), F.lit(0), lambda a, x: a + x)).otherwise(0)
    count = {n_entities: (F.col(parts) + mentions).cast("long")} if n_entities else {}
    hit = hit.withColumns({**count, text: joined}).drop(mark, own, new, names, others, parts)
    rest = docs.where(~has)
    return hit.unionByName(rest.withColumn(n_entities, F.lit(0).cast("long")) if n_entities else rest)


def session_key(spark: SparkSession) -> str:
    """The key that the session names in ``spark.tidewatch.pii.key``.

    Without one a random key is drawn, so surrogates can't be computed again by whoever has the code, nor be the same in
    another application.
    """
    return spark.conf.get("spark.tidewatch.pii.key", None) or secrets.token_hex(32)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in the place of personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, key=session_key(spark), n_entities="n_entities")
