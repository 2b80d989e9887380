"""Variant spellings of names typed by people, linked to the person or organisation they mean.

Each row is read for spellings: of the typed name, and of the mailbox where it is spelled out. Rows with
an equal spelling or personal mailbox belong together at once. Different spellings are compared only
within blocks: one word as it is, nicknames resolved, with the other's phonetic code and a form it has with
a letter left out. Spellings one typing error apart always have a block in common, and a block holds few
different spellings however many rows there are. Pairs are compared by Jaro-Winkler and a table of
nicknames, and linked if one typing error leads from one to the other, unless mailboxes of their own confirm
both. Links are clustered by connected components; a spelling that is near several confirmed ones is linked to
the most alike of these only, as they are different people.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.functions.fuzzy import jaro_winkler
from strataquery.operators.components import components
from strataquery.plans.skew import salted_join
from strataquery.session import stored

#: Least similarity of a word to what a login shows, and of words of up to SHORT letters; words from LONG letters on have their forms hashed in one go.
LIKE, SHORT, LONG = 0.86, 4, 200

#: Nicknames and other spellings by first name: those of common English, German and Romance first names, and rarer ones (fixed values).
NICKNAMES = {
    "alexander": "alex sasha xander sascha lex", "anneliese": "anni anne liesl lise", "augustin": "gus august gustl", "bartholomew": "bart barty mew", "benjamin": "ben benny benji",
    "bjorn": "bjoern", "brunhilde": "bruni hilde", "caterina": "cat rina cati", "christopher": "chris kit topher", "cornelius": "neil con corny nelius", "desdemona": "mona des desi", "dominika": "nika domi dom",
    "eleonora": "nora leo elly ella", "elizabeth": "beth liz betty eliza lizzy lisa", "emmanuel": "manu manny emm", "fiorella": "fio ella", "francisco": "paco fran pancho cisco", "frederic": "fred fredi freddy frederick",
    "gabriela": "gabi gaby gabby", "giovanna": "gia gianna vanna", "guillermo": "memo guille", "henrietta": "hetty etta henni", "hildebrand": "hilde brand", "huseyin": "huso", "isidora": "isi dora",
    "jeremiah": "jerry jem", "johannes": "jo hannes johann hans", "josephine": "jo jose josy josie fifi", "katherine": "kate kathy katie kit kay", "konstantin": "kostja kosta konsti stan", "leopold": "poldi leo",
    "lukasz": "luk luke", "magdalena": "lena magda maggie", "margarete": "greta grete gitte marga gretel maggie meg", "maximilian": "max maxi", "michael": "mick mike michi", "milos": "milo", "nathaniel": "nat nate",
    "octavia": "tavi via", "robert": "rob bob bobby robbie bert", "rosalinde": "rosi rosa linde", "sebastian": "seb bastian basti", "seraphina": "fina sera", "theodora": "thea dora theo teddy", "thaddeus": "tad thad",
    "tomas": "tom tommy thomas", "valentina": "tina val vale", "wilhelmina": "mina willa minna", "william": "will bill billy liam", "xaverius": "xaver", "zacharias": "zach zack", "zoe": "zo",
    "adelheid": "heidi", "aurelio": "lelio", "ferdinand": "ferdi", "gwendolyn": "gwen", "ignatius": "iggy", "jacqueline": "jackie", "kazimir": "kaz", "lorenzo": "enzo", "marcelina": "celina", "melisande": "meli",
    "ludovico": "vico", "nikolaus": "klaus niko", "norberto": "berto", "ottoline": "otti", "patrizia": "pat", "radomir": "radek", "tabitha": "tabby", "ulrike": "uli", "ursula": "uschi", "vasilis": "vas", "wilfried": "willi", "yevgenia": "zhenya", "yolanda": "yoli",
    "abigail": "abby gail", "albert": "al albie bertie", "alfred": "alf alfie", "andreas": "andi", "andrew": "andy drew", "angela": "angie", "anthony": "toni tony", "antonio": "tonio", "arthur": "art artie", "barbara": "barb babs bärbel barbie",
    "bernhard": "bernd bernie", "bradley": "brad", "catherine": "cathy cathie", "charles": "charlie charley chuck", "charlotte": "lottie lotte", "christina": "chrissy tina", "clifford": "cliff", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davy",
    "deborah": "deb debbie", "dennis": "denny", "dominic": "nic", "donald": "don donny", "dorothy": "dot dottie dolly", "douglas": "doug", "edmund": "eddy", "edward": "ed ted eddie ned", "eugene": "gene", "florence": "flo flossie", "franklin": "frankie",
    "friedrich": "fritz", "geoffrey": "geoff", "gerald": "gerry", "gilbert": "gil", "gregory": "greg", "harold": "hal", "heinrich": "heiner heinz", "helena": "leni", "henry": "hank harry", "herbert": "herb", "ignacio": "nacho", "jacob": "jake", "james": "jim jimmy jamie",
    "janet": "jan", "jennifer": "jen jenny", "jonathan": "jon", "john": "jack johnny", "joseph": "joe joey", "joshua": "josh", "judith": "judy", "kenneth": "ken kenny", "kimberly": "kim", "lawrence": "larry laurie", "leonard": "len lenny", "louis": "lou louie",
    "manuel": "manolo", "margaret": "peggy madge marge", "martin": "marty", "mary": "molly polly", "matthew": "matt matty", "mildred": "millie", "mitchell": "mitch", "nancy": "nan", "nicholas": "nick nicky", "oliver": "ollie", "pamela": "pam", "patricia": "patty trish tricia",
    "patrick": "paddy", "peter": "pete", "philip": "phil pip", "prudence": "prue", "raymond": "ray", "rebecca": "becky becca", "reginald": "reg reggie", "richard": "dick rich richie rick ricky", "ronald": "ron ronnie", "rudolf": "rudi", "russell": "russ", "samuel": "sam sammy",
    "stanley": "stan", "stephen": "steve stevie", "steven": "steve", "stuart": "stu", "susan": "sue susie suzie", "terence": "terry", "timothy": "tim timmy", "tobias": "tobi toby", "victoria": "vicky vickie", "vincent": "vince vinny", "virginia": "ginny", "walter": "walt wally",
    "wolfgang": "wolf",
}
#: Words of organisations' names, and of mailboxes that belong to a role (fixed values).
ORG_WORDS = set("consulting cons labs lab laboratories laboratory software soft sw systems system sys technologies technology tech co company inc ltd gmbh llc ag sa s.a corp group the team".split())
ROLES = set("info build builds dev git team root admin office contact support mail hello noreply ci bot sales help jobs ops".split())
_NOBODY = set("unknown none null nobody user name anonymous n/a na".split())

_FULL = {}
for _first, _nicks in NICKNAMES.items():
    for _nick in _nicks.split():
        _FULL.setdefault(_nick, []).append(_first)

_LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "AE", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
_CODES = {**dict.fromkeys("aeiouyhw", "a"), **dict.fromkeys("bp", "b"), **dict.fromkeys("fv", "f"), **dict.fromkeys("ckgqx", "k"), **dict.fromkeys("sz", "s"), **dict.fromkeys("dt", "t"), **dict.fromkeys("mn", "m"), "j": "j", "l": "l", "r": "r"}


def plain(text: str) -> str:
    """Without wrongly decoded characters and diacritics."""
    try:
        text = text.encode("latin-1").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        pass
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_LETTERS)) if not unicodedata.combining(c))


def phonetic(word: str) -> str:
    """Classes of like-sounding letters, repeats once; vowels count as one class."""
    out = []
    for c in word:
        code = _CODES.get(c, c)
        if not out or out[-1] != code:
            out.append(code)
    return "".join(out)


def mailbox(email: str | None) -> tuple[str, str] | None:
    """(local part, domain) without case, tag, account number and `mail.`; None if it is none."""
    if not email or "@" not in email:
        return None
    local, domain = plain(email.strip()).lower().rsplit("@", 1)
    local = re.sub(r"^\d+\+", "", local).split("+")[0].strip()
    return (local, re.sub(r"^(?:mail|smtp)\.", "", domain.strip())) if local else None


def name_tokens(name: str | None) -> list[str]:
    """Words of a typed name in lower case, without titles, remarks and middle initials."""
    if not name or not name.strip():
        return []
    text = plain(name).strip()
    if "@" in text:
        box = mailbox(text)
        text = box[0] if box else ""
    text = re.sub(r"\([^()]*\)|\[[^\[\]]*\]|\bvia\s+\S+$", " ", text)
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text.replace("GmbH", "gmbh"))
    tokens = [t.strip("'`") for t in re.split(r"[\s,._\-&/]+", text.lower())]
    tokens = [t for t in tokens if t and t not in ("dr", "prof", "mr", "mrs", "ms", "ing", "jr", "sr")]
    if tokens and all(t in _NOBODY for t in tokens):
        return []
    long = [t for t in tokens if len(t) > 1]
    return long if len(long) >= 2 else tokens


def _whole(token: str) -> list[str]:
    """First names a token stands for; itself if it is no nickname."""
    return _FULL.get(token, [token])


def _forms(first: str, last: str) -> set[str]:
    """Logins made of a name."""
    return {first[0] + last, last + first[0], last + first[:2], first[:2] + last, first + last, last + first}


def one_error(x: str, y: str) -> bool:
    """Whether one letter replaced, left out, added or swapped with its neighbour leads from x to y."""
    if len(x) > len(y):
        x, y = y, x
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    if len(x) == len(y):
        return x[i + 1 :] == y[i + 1 :] or (x[i : i + 2] == y[i : i + 2][::-1] and x[i + 2 :] == y[i + 2 :])
    return len(y) - len(x) == 1 and x[i:] == y[i + 1 :]


def _like(x: str, y: str) -> float:
    """Jaro-Winkler similarity."""
    return jaro_winkler(x, y)


def _near(x: str, y: str) -> float:
    """Similarity of words one typing error apart, else 0; short words must be alike besides."""
    if not one_error(x, y):
        return 0.0
    like = jaro_winkler(x, y)
    return like if min(len(x), len(y)) > SHORT or like >= LIKE else 0.0


class Reading:
    """What one row says: strong keys, weak keys, and spellings (two words, and for each whether the mailbox spells it)."""

    def __init__(self, name: str | None, email: str | None) -> None:
        self.keys: list[str] = []
        self.weak: list[str] = []
        self.spellings: list[tuple[str, str, bool, bool]] = []
        self.box: str | None = None
        if email and "@" not in email and not (name and name.strip()):
            name, email = email, None
        if name and "@" in name and email and "@" not in email:
            name, email = email, name
        tokens, box = name_tokens(name), mailbox(email)
        if self._organisation(tokens, box):
            return
        local = box[0] if box else ""
        parts = [p for p in re.split(r"[._\-]+", re.sub(r"\d+$", "", local)) if len(p) > 1 and p.isalpha()]
        role = local in ROLES
        compact = re.sub(r"\d+$", "", re.sub(r"[._\-]", "", local))
        full = tokens if len(tokens) >= 2 and all(len(t) > 1 and t.isalpha() for t in tokens) else []
        full = [full[0], full[-1]] if len(full) > 2 else full
        spelled = parts if len(parts) == 2 and not role else []
        mine = bool(box) and not role and len(compact) >= 4
        if full:
            agrees = False
            if spelled:
                agrees = any(_like(a, b) >= 0.85 for a in full if len(a) > 3 for b in spelled)
            elif mine:
                agrees = self._login(full, compact)
            if not agrees:
                spelled, mine = [], False
            self._spell(full, compact if agrees else "")
        if spelled:
            self._spell(spelled, compact)
        if mine:
            self.box = f"mb:{local}@{box[1]}"
            self.keys.append(self.box)
        if not full and not spelled:
            if mine and len(compact) >= 6:
                self.weak.append(f"lg:{compact}")
            long = [t for t in tokens if len(t) > 1]
            short = [t for t in tokens if len(t) == 1]
            if len(long) == 1 and len(short) == 1 and len(long[0]) > 5:
                self.weak.append(f"il:{short[0]}|{long[0]}")
            elif len(long) == 1 and not short and len(tokens[0]) >= 6:
                self.weak.append(f"lg:{re.sub(r'[0-9]+$', '', tokens[0])}")

    def _organisation(self, tokens: list[str], box: tuple[str, str] | None) -> bool:
        label = re.sub(r"-(?:it|labs|dev|online|group)$", "", box[1].split(".")[0]) if box else ""
        role = bool(box) and box[0] in ROLES
        marked = [t for t in tokens if t in ORG_WORDS]
        rest = [t for t in tokens if t not in ORG_WORDS and len(t) > 1]
        near = role and len(rest) == 1 and _like(rest[0], label) >= 0.85
        if not (near or (len(rest) == 1 and marked) or (role and not tokens)):
            return False
        if near or (role and not tokens):
            (self.keys if near else self.weak).append(f"org:{label}")
        if rest:
            self.keys.append(f"org:{rest[0]}")
            self.spellings.append(("", rest[0], True, near and rest[0] == label))
            if near and rest[0] != label:
                self.spellings.append(("", label, True, True))
        return True

    def _spell(self, pair: list[str], shown: str) -> None:
        """Takes a spelling; shown is the mailbox's login, which may spell either word."""
        a, b = pair
        if (b in NICKNAMES or b in _FULL) and a not in NICKNAMES and a not in _FULL:
            a, b = b, a
        if len(_whole(a)) > 1:  # several first names share this nickname
            self.weak.extend("nm:" + "|".join(sorted((f, b))) for f in _whole(a))
            self.keys.append("nk:" + "|".join(sorted((a, b))))
            return
        first = _whole(a)[0]
        sure = {first: a in shown or first in shown, b: b in shown}
        x, y = sorted((first, b))
        self.keys.append(f"nm:{x}|{y}")
        self.spellings.append((x, y, sure[x], sure[y]))

    def _login(self, full: list[str], compact: str) -> bool:
        """Whether a login is made of the name, perhaps mistyped; then the spelling it shows is taken too."""
        best = None
        for a, b in ((full[0], full[1]), (full[1], full[0])):
            for first in {a, *_whole(a)}:
                rest = compact.removeprefix(b) if compact.startswith(b) else compact.removesuffix(b) if compact.endswith(b) else "?"
                if compact in _forms(first, b) or (len(b) > 3 and len(rest) in (1, 2) and rest[0] == first[0]):
                    return True
                for lead, rest in ((first[0], 0), (first[:2], 0), (first[0], 1), (first[:2], 1)):
                    if compact.startswith(lead) and not rest:
                        shown = compact[len(lead) :]
                    elif rest and compact.endswith(lead):
                        shown = compact[: -len(lead)]
                    else:
                        continue
                    like = _near(shown, b) or _like(shown, b)
                    if len(shown) > 4 and like >= LIKE and (best is None or (like, -abs(len(shown) - len(b))) > best[0]):
                        best = ((like, -abs(len(shown) - len(b))), first, shown)
        if best:
            self._spell([best[1], best[2]], compact)
        return best is not None


def _hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [Reading(n, e) for n, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        spelled = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("sa", pa.bool_()), ("sb", pa.bool_())]))
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([r.box for r in rows], pa.string()),
                pa.array([sorted(set(r.keys)) for r in rows], strings),
                pa.array([sorted(set(r.weak)) for r in rows], strings),
                pa.array([[dict(zip(("a", "b", "sa", "sb"), x, strict=True)) for x in r.spellings] for r in rows], spelled),
            ],
            names=["id", "box", "keys", "weak", "spellings"],
        )


def _left_out(word: str) -> set[str]:
    """A word whole and with each letter left out; words one typing error apart have one of these in common."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _form_hashes(word: str) -> set[int]:
    """Hashes of the same forms in time proportional to the word, for words of LONG letters and more."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    powers = np.cumprod(np.full(n, _BASE, np.uint64)) * np.uint64(pow(_BASE, -1, 1 << 64))  # 1, B, B^2, ...
    front = np.r_[np.uint64(0), np.cumsum(codes * powers)]  # of the first i letters
    back = (front[n] - front[1:]) * np.uint64(pow(_BASE, -1, 1 << 64))  # of the letters after i, one place further left
    return {int(front[n]), *(front[:-1] + back).tolist()}


_BASE = 0x9E3779B97F4A7C15


def blocks(a: str, b: str) -> list[int]:
    """Blocks of a spelling, as hashes: one word with nicknames resolved; the other's form and the form's phonetic code.

    Either word may be the equal one, as an error may change their order. The letter is left out before
    coding: one error can change a code in more than one place. Words around LONG letters have both kinds of forms.
    """
    out = set()
    for equal, other in ((a, b), (b, a)):
        for whole in _whole(equal):
            if len(other) <= LONG:
                out |= {_hash(f"{phonetic(form)}|{form}|{whole}") for form in _left_out(other)}
            if len(other) >= LONG:
                out |= {_hash(f"{form}#{whole}") for form in _form_hashes(other)}
    return sorted(out)


def alike(one: tuple, two: tuple) -> tuple[float, bool, bool]:
    """(similarity, one asks, two asks) of spellings (a, b, sure of a, sure of b) that can be one name mistyped, else zeros.

    One word must be equal, nicknames included. The other may be mistyped, but not if mailboxes spell it
    on both sides; the side whose mailbox does not is the one that asks.
    """
    best = (0.0, False, False)
    (a1, b1, p1, q1), (a2, b2, p2, q2) = one, two
    for x1, s1, y1, t1, x2, s2, y2, t2 in ((a1, p1, b1, q1, a2, p2, b2, q2), (b1, q1, a1, p1, b2, q2, a2, p2), (a1, p1, b1, q1, b2, q2, a2, p2), (b1, q1, a1, p1, a2, p2, b2, q2)):
        if x1 == x2 or set(_whole(x1)) & set(_whole(x2)):
            like = _near(y1, y2)
            if like > best[0] and not (t1 and t2):
                best = (like, not t1, not t2)
    return best


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of spellings to links (key asking, key asked, whether that one is confirmed, score)."""
    for batch in batches:
        rows = []
        columns = [c.to_pylist() for c in batch.columns]
        for values in zip(*columns, strict=True):
            one, two = values[:4], values[4:]
            score, first, second = alike(one, two)
            if score:
                k1, k2 = (f"nm:{x[0]}|{x[1]}" if x[0] else f"org:{x[1]}" for x in (one, two))
                rows.extend([(k1, k2, not second, score)] * first + [(k2, k1, not first, score)] * second)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["k1", "k2", "confirmed", "score"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spellings (a, b, sa, sb) with their blocks and the weak keys they answer."""
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        met = pa.array([blocks(x, y) for x, y in zip(a, b, strict=True)], pa.list_(pa.int64()))
        asked = pa.array([_offers(x, y) for x, y in zip(a, b, strict=True)], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, met, asked], names=["a", "b", "sa", "sb", "blocks", "offers"])


def _offers(a: str, b: str) -> list[str]:
    """Weak keys that a full spelling answers."""
    if not a:
        return [f"org:{b}"]
    out = {f"nm:{a}|{b}"}
    for first, last in ((a, b), (b, a)):
        out |= {f"lg:{f}" for f in _forms(first, last)}
        out |= {f"il:{first[0]}|{last}", f"lg:{last}"}
    return sorted(out)


def _close_spellings(spellings: DataFrame) -> DataFrame:
    """(k1, k2) of different spellings that mean the same.

    Blocks need no splitting: two spellings in one have a word in common and another that differs by a
    letter, so a block has at most as many as an alphabet has letters, times the places for one.
    """
    met = spellings.select("a", "b", "sa", "sb", F.explode("blocks").alias("block"))
    one, two = (met.select(*[F.col(c).alias(f"{c}{i}") for c in ("a", "b", "sa", "sb")], "block") for i in (1, 2))
    sides = [f"{c}{i}" for i in (1, 2) for c in ("a", "b", "sa", "sb")]
    pairs = one.join(two, "block").where("(a1, b1) < (a2, b2)").select(*sides).distinct()
    links = stored(pairs.mapInArrow(_pairs, "k1 string, k2 string, confirmed boolean, score double"), "links")
    best = links.where("confirmed").groupBy("k1").agg(F.max_by("k2", F.struct("score", "k2")).alias("k2"))
    return links.where("not confirmed").select("k1", "k2").union(best).distinct()


def linked(authors: DataFrame) -> DataFrame:
    """(author_id, entity): rows that share an entity with another row; entity is the least author_id of it.

    Rows without author_id are left out, repeated rows count once; a row whose name and mailbox say
    nothing of anyone comes out nowhere.
    """
    rows = stored(
        authors.where("author_id is not null")
        .select(F.col("author_id").cast("long").alias("id"), "name", "email")
        .distinct()
        .mapInArrow(_read, "id long, box string, keys array<string>, weak array<string>, spellings array<struct<a: string, b: string, sa: boolean, sb: boolean>>"),
        "read",
    )
    distinct = rows.select(F.explode("spellings").alias("s")).groupBy("s.a", "s.b").agg(F.max("s.sa").alias("sa"), F.max("s.sb").alias("sb"))
    spellings = stored(distinct.mapInArrow(_expand, "a string, b string, sa boolean, sb boolean, blocks array<long>, offers array<string>"), "spellings")
    strong = rows.select("id", F.explode("keys").alias("key"))
    named = rows.where("exists(keys, k -> k like 'nm:%')").select("box").where("box is not null").distinct().withColumn("named", F.lit(True))
    asking = rows.where("size(weak) > 0").join(named, "box", "left").where("named is null").select("id", F.explode("weak").alias("ask"))
    key = F.when(F.col("a") == "", F.concat(F.lit("org:"), "b")).otherwise(F.concat(F.lit("nm:"), "a", F.lit("|"), "b"))
    offered = spellings.select(key.alias("key"), F.explode("offers").alias("ask"))
    # An ask counts if all its offers, and those of the row's other asks, are one; so two of them are enough.
    offers = offered.groupBy("ask").agg(F.min("key").alias("key"), F.max("key").alias("other"))
    weak = asking.join(offers, "ask").groupBy("id").agg(F.min("key").alias("key"), F.max("other").alias("other")).where("key = other").select("id", "key")
    # Each key's rows form a star around its least row: one edge per row and key.
    edges = stored(strong.union(weak).distinct(), "keys")
    centres = edges.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n"))
    centres = stored(centres, "centres")
    close = _close_spellings(spellings)
    ends = lambda k, n: centres.select(F.col("key").alias(k), F.col("centre").alias(n))
    same = close.join(ends("k1", "a"), "k1").join(ends("k2", "b"), "k2").select("a", "b")
    stars = salted_join(edges, centres.select("key", "centre"), ["key"], centres.select("key", "n"), "n", F.xxhash64("id")).select(F.col("id").alias("a"), F.col("centre").alias("b"))
    return components(stars.union(same)).select(F.col("id").alias("author_id"), F.col("component").alias("entity"))


def p2_found(spark, folder):
    """All pairs of rows of one entity, as the task asks; their number is that of the result."""
    from strataquery.sources.tables import table

    rows = stored(linked(table(spark, folder, "authors", "author_id", "name", "email")), "entities")
    sizes = rows.groupBy("entity").agg(F.count("*").alias("n"))
    other = rows.select(F.col("author_id").alias("author_id_b"), "entity")
    met = salted_join(rows.withColumnRenamed("author_id", "author_id_a"), other, ["entity"], sizes, "n", F.xxhash64("author_id_a"), least=2_000)
    return met.where("author_id_a < author_id_b").select("author_id_a", "author_id_b")


def p2_entities(spark, folder):
    """One row per linked author row with its entity and the entity's size."""
    from strataquery.sources.tables import table

    rows = stored(linked(table(spark, folder, "authors", "author_id", "name", "email")), "entities")
    return rows.join(rows.groupBy("entity").agg(F.count("*").alias("n_rows")), "entity").select("author_id", "entity", "n_rows")
