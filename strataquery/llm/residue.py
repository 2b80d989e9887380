"""Template residue, filler, error pages and script notices instead of content.

Every line is split into tokens with numbers and hashes masked. The scan goes down a prefix tree of fixed depth
and drops the lines of leaves in which no message can begin so, nearly all. The others are mined in one tree for
the whole corpus: a leaf (number of tokens, first DEPTH tokens) holds groups of similar lines, and a group's
template keeps the tokens in which all its lines agree. Each template is classified once and its verdict goes to
all its lines. Where its fixed tokens do not settle the verdict for whatever stands in the gaps, it is split at its
first gap until they do: so no other line or document can hide or make a message, and documents are found alike
however the corpus is divided. A line that ends within the tree is its leaf's only template. Slots left unfilled
in ordinary records are found apart, by the shape of the line they stand in; code, quotations and prose about such
things are no cases.

Texts are read once and whole. A line longer than RUN_ON tokens, or one that starts with markup, is no
message as it stands but may hold some: it is cut at tags and ends of sentences, and counts if its first
piece, a heading or title, a script notice in `<noscript>`, or two pieces in a row read as messages.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby, pairwise
from operator import eq

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.plans.skew import BROADCAST_BYTES, input_bytes, salted_join
from strataquery.session import stored

#: Depth of the prefix tree; lines of more tokens than RUN_ON are read in pieces.
DEPTH, RUN_ON = 4, 40
#: Letters of a token that the tree looks at; the verdict itself reads whole tokens.
WORD = 64
#: Leaves and templates a task remembers; a forgotten one is classified anew.
HELD_LEAVES = 100_000
#: Share of equal tokens with which a line joins a group of its leaf (fixed value).
ALIKE = 0.5
#: Groups of a leaf that take lines at once, lines and letters held for a leaf; beyond them groups are closed and
#: lines like theirs open others. A leaf of more lines is mined in several parts.
HELD_GROUPS, HELD_LINES, HELD_LETTERS = 16, 100_000, 1 << 26
#: A gap of a template as shapes see it: only `.*` reads it, as it reads any token. No letter and no mark.
GAP = "\uffff"

_VARIABLE = re.compile(r"[0-9]")
_IN_TAG = re.compile(r"(?<=>)[45]\d\d$")
_STATUS = re.compile(r"^\(?[45]\d\d\)?[.:,]?$")
_STATUS_NAME = r"(?:bad request|unauthorized|forbidden|not found|page not found|request timeout|gone|too many requests|internal server error|bad gateway|service unavailable|service temporarily unavailable|gateway time-?out)"

#: Shapes of whole lines, lower case, `<*>` for what varies, by kind (fixed values).
MESSAGES = {
    "error": (
        rf"(?:http(?:/<\*>)? |error |erreur |fehler )?<status>(?: error)? ?(?:[-:–—|] ?)?{_STATUS_NAME}[.!]?",
        r"(?:error|erreur|fehler) <status> ?[.:]? .*(?:encontrar|introuvable|gefunden|found|página|page|seite).*",
        r"(?:seite|datei|page|página) (?:nicht gefunden|introuvable|no encontrada|not found)\b.*",
        r"die angeforderte (?:datei|seite) .*",
        r"(?:oops|sorry|whoops|hoppla)\b[!,.]? .*(?:page|wrong|seite|loading).*",
        r"go back to the (?:start|home) page or search again\.?",
        r"zurück zur startseite\.?|volver al inicio\.?|revenez à l'accueil\.?",
        r"(?:access|permission|zugriff|accès|acceso) (?:denied|verweigert|refusé|denegado)[.!]?",
        r"you (?:do not|don't) have (?:permission|access) to (?:view|access|see) this .*",
        r"you (?:are not|aren't) (?:authori[sz]ed|allowed|permitted) to (?:view|access|see|visit) this (?:page|site|file|resource|repository|document)\b.*",
        r"(?:we are|we're|this site is) down for .*maintenance.*",
        r"(?:the|this|our) (?:site|website|service|server) is (?:currently |temporarily )(?:unavailable|offline|down|under maintenance)\b.*",
        r"(?:rate limit|too many requests?)\b.*(?:retry|try again|reached).*",
        r"upstream connect error or disconnect.*",
        r"(?:your )?session (?:has )?(?:expired|timed out)\b.*(?:sign|log) in.*",
        r"(?:please |you must |you need to )(?:sign|log) ?in to (?:continue|(?:view|access|see) this (?:page|file|content|repository)).*",
        r"this file is too large to be displayed.*",
        r"the server at .* gave no further detail\.?",
        r"(?:please )?(?:verify|confirm) (?:that )?you are (?:a )?(?:human|not a robot).*",
        r"please (?:complete|solve) the (?:captcha|security check|challenge)\b.*",
        r"checking your browser before .*|attention required!.*|just a moment\.\.\.|ddos protection by .*",
        r"(?:your |this )?request (?:has been |was )?blocked\b.*",
        r"the requested (?:url|page|resource|file|document)\b.*(?:not found|not be found|does not exist|n't exist).*",
        r"the (?:page|resource|file|document|link) you (?:(?:are|were) (?:looking for|requesting|after|trying to (?:reach|access|view))|requested|followed)\b.*(?:\bnot\b|n't|moved|removed|unavailable|no longer|broken|expired).*",
        r"(?:we|i) (?:can't|cannot|can not|could not|couldn't) (?:find|locate) (?:the|that|this) page\b.*",
        r"this (?:page|site) (?:isn't|is not|is no longer|can't be|cannot be|could not be|doesn't) (?:available|found|displayed|working|exist|reached|accessible)\b.*",
        r"an? (?:unexpected |internal |unknown |application |server )?error (?:has )?occurred\b.*(?:try again|later|administrator|contact|support).*",
        r"something went wrong\b(?:.*(?:try again|reload|refresh|later).*|[.!]?)",
        r"whitelabel error page|this application has no explicit mapping for .*|error establishing a database connection[.!]?|<status>\.? that['’]s an error\b.*",
        r"(?:die|diese) (?:gesuchte |gewünschte )?(?:seite|adresse) (?:wurde nicht gefunden|konnte nicht gefunden werden|existiert nicht|ist (?:derzeit )?nicht (?:verfügbar|erreichbar))\b.*",
        r"(?:ein|es ist ein) (?:interner |unerwarteter )?fehler (?:ist )?aufgetreten\b.*(?:später|erneut).*",
        r"(?:cette|la) page (?:demandée |que vous (?:cherchez|recherchez|demandez) )?(?:n'existe (?:pas|plus)|est introuvable|n'est (?:pas|plus) disponible|n'a pas été trouvée)\b.*",
        r"une erreur (?:inattendue |interne )?(?:est survenue|s'est produite)\b.*(?:réessayer|réessayez|plus tard).*",
        r"(?:esta|la) página (?:que (?:busca|buscas|solicitó) |solicitada )?(?:no existe|no está disponible|no se (?:ha )?(?:podido )?encontr\w+)\b.*",
        r"(?:ha ocurrido|se ha producido) un error\b.*(?:de nuevo|más tarde).*",
    ),
    "script": (
        r"(?:please |you need to |you must )?(?:enable|activate|turn on|allow) (?:javascript|scripts?|scripting)\b.*",
        r"(?:javascript|scripts?|scripting) (?:is|are|must be|has been|seems to be|appears to be) (?:currently )?(?:switched off|disabled|turned off|not enabled|required|allowed|enabled|needed)\b.*",
        r"(?:this )?(?:web ?)?(?:site|page|app|application|viewer) (?:requires|needs) (?:javascript|scripts?)\b.*",
        r"your browser (?:is not supported or has scripting disabled|does not support javascript|has javascript (?:disabled|turned off))\b.*",
        r"you need (?:to have )?javascript (?:enabled )?(?:to|in order to)\b.*",
        r"(?:to|in order to|for full functionality of) .*(?:please|need to|must|necessary to) (?:enable|turn on|activate|allow) javascript\b.*",
        r"we(?:'|’)?(?:re| are) sorry,? but .*without javascript\b.*",
        r"(?:bitte )?aktivieren sie (?:bitte )?javascript\b.*|(?:activa|active|habilite|habilita|por favor,? activ\w+) javascript\b.*|(?:veuillez )?(?:activer|activez) javascript\b.*",
        r"javascript (?:ist (?:deaktiviert|nicht aktiviert|erforderlich)|est (?:désactivé|requis|nécessaire)|está (?:desactivado|deshabilitado)|es necesario)\b.*",
        r"diese (?:ansicht|seite) (?:funktioniert nur mit|benötigt|erfordert) .*(?:skript|javascript).*|cette page (?:nécessite|requiert) javascript.*|esta página (?:necesita|requiere) javascript.*",
    ),
    "hint": (
        r"(?:describe|explain) (?:what you changed|the change|your change).*",
        r"_?replace (?:me|this|this line|this text) (?:with|by) .*",
        r"\?{2,}.*\?{2,}",
        r"(?:…|\.{3}) ?fill (?:me )?in ?(?:…|\.{3})|fill (?:me )?in(?: here)?",
        r"\(?(?:kurz beschreiben|hier beschreiben).*|\(?bitte (?:ausfüllen|ergänzen).*",
        r"\(?(?:rellenar|completar) antes de enviar.*",
        r"\(?à compléter.*|\(?à remplir.*",
        r"\(?please replace this (?:line|text|section) .*",
        r"write your (?:answer|text|summary|description) (?:below|here).*",
        r"n/a or explain",
        r"\[?(?:screenshot|screenshots)\]?",
        r"(?:section )?(?:text|content|copy) (?:to be supplied|to follow|goes here|coming soon)\.?",
        r"body copy for .* will (?:be placed|follow).*",
        r"(?:optional|delete this (?:hint|line|section).*)",
        r"lorem ipsum\b.*|ipsum lorem\b.*",
        r"(?:dummy|sample|filler|placeholder) text:.*",
        r"(?:content|page) coming soon\.?",
        r"(?:(?:text goes here|your (?:content|text) here|texto de relleno|texte provisoire|sample paragraph|blindtext|foo bar baz(?: qux)?|blah)[ .,]*)+",
        r"a clear and concise description of (?:what|any) .*",
        r"add any other (?:context|information) (?:or screenshots )?about the .* here\.?",
        r"if applicable, add screenshots to help .*",
        r"(?:enter|insert|add|type|put|write) (?:your |a |the )?(?:text|content|title|description|summary|name|answer|comment)(?: text)? here\.?",
        r"click (?:here )?to (?:add|edit) (?:text|title|subtitle)\.?",
        r"this is (?:a |just |only )?(?:a )?(?:placeholder|dummy text|sample text|filler text)\.?",
        r"(?:please )?(?:provide|include|fill in|add) (?:a |your )?(?:short |brief )?(?:description|summary) (?:of .* )?(?:here|below)\.?",
        r"(?:inhalt|text) folgt\.?|hier (?:text|beschreibung) einfügen\.?|texte à (?:venir|insérer)\.?|insérer (?:le |votre )?texte ici\.?|insertar (?:el )?texto aquí\.?|escriba (?:su texto )?aquí\.?",
    ),
}
#: Starts of lines that hold an answer of a server in code, with the parts that make it an error.
_ANSWER = regex.compile(rf'\{{"(?:status|code|error|message)": (?:<status>|"?{_STATUS_NAME}"?).*\b{_STATUS_NAME}"')
#: A notice that says last what does not work; it starts with anything.
_TAIL = regex.compile(r".* (?:does not work|doesn't work|cannot run|will not work|won't work) (?:properly )?without (?:javascript|scripts?)(?: enabled)?[.!]?")
_FAMILIES = [(kind, regex.compile("|".join(f"(?:{p})" for p in shapes))) for kind, shapes in MESSAGES.items()]
_ENDS = tuple(f"{word}{end}{mark}" for word in ("javascript", "script", "scripts") for end in ("", " enabled") for mark in ("", ".", "!"))
#: Shapes that are a case only behind a comment mark or in brackets.
_WRAPPED = re.compile(r"^\s*(?:<!--|\(|\[)")
_BARE_WORDS = re.compile(r"^(?:optional|fill (?:me )?in(?: here)?)$")

_NAME = r"[A-Za-z]+(?:[ _.\-][A-Za-z]+){0,3}"
#: Notations of slots (fixed values).
_SLOT = re.compile(
    rf"\{{\{{-? *{_NAME} *-?\}}\}}|\{{% *{_NAME} *%\}}|<%=? *{_NAME} *%>|\[(?:INSERT|Insert|insert) {_NAME}(?: HERE| here)?\]|\[(?:YOUR|Your|your) {_NAME}\]|<(?:your|YOUR|insert)[- ]{_NAME}>|&lt;{_NAME}&gt;|<{_NAME}>"
    rf"|__{_NAME}__|%{_NAME}%|\$\{{{_NAME}\}}|\$\${_NAME}\$\$|#\{{{_NAME}\}}|@@{_NAME}@@|«{_NAME}»|\{{{_NAME}\}}|\({_NAME} (?:goes here|GOES HERE)\)|(?<![xX])[xX]{{3,}}-{_NAME}-[xX]{{3,}}|\[\[{_NAME}\]\]|\bTBD: ?{_NAME}|\bTBD\b"
)
_LABEL = re.compile(r"^[A-Za-z]+(?: [A-Za-z]+){0,2}$")
_CODE = re.compile(r"""[`"';=]|=>|\(\)|\b(?:const|return|println|let|var|using|import)\b|</|/>|<h\d>|\|""")
_CAMEL = re.compile(r"[a-z][A-Z]")
#: Syllables of invented Latin, and the keys under the resting fingers (fixed values).
_LATIN_WORD = re.compile(r"(?:lor|em|ip|sum|dol|do|sit|am|et|con|sec|te|tur|ad|pis|cing|el|it|ul|la|mol|bi|ra|lo|rem|vel|qua|fer|na|tis|mor|is|or|ut)++")
_MASHED = re.compile(r"[asdfghjklqweru]+$")
_WORDS = re.compile(r"[^\W\d_]+")
_NUMBERED = re.compile(r"^\d+\.$")


def _bare(line: str) -> str:
    """A line without list, heading, table and comment marks around it."""
    text, before = line.strip(), None
    while text != before:
        before = text
        text = text.removeprefix("<!--").lstrip("#>*-+=|( \t").removesuffix("-->").rstrip("*_=|) \t")
    return text


def _mask(token: str) -> str:
    if not _VARIABLE.search(token):
        return token
    if "<" in token:
        return _IN_TAG.sub("<status>", token)
    return "<status>" if _STATUS.match(token) else "<*>"


def masked(line: str) -> list[str]:
    """Tokens of a line without list and comment marks; a status code becomes `<status>`, other tokens with digits `<*>`."""
    return [_mask(t) for t in _bare(line).lower().split()]


def leaf(tokens: list[str]) -> tuple[int, str]:
    """The prefix tree's leaf: the number of tokens, and the first DEPTH of them."""
    return len(tokens), " ".join(tokens[:DEPTH])


@lru_cache(HELD_LEAVES)
def is_open(head: str, more: bool) -> bool:
    """Whether any message can begin as the lines of a node or leaf do; its class, found once."""
    text = head + " " if more else head
    return any(family.fullmatch(text, partial=True) for _, family in _FAMILIES) or _may_answer(text)


def _may_answer(start: str) -> bool:
    return start.startswith('{"') and bool(_ANSWER.match(start, partial=True))


def _kind(text: str) -> str | None:
    """Kind of residue of a template, masked tokens joined by blanks; long ones are not remembered."""
    return _classified(text) if len(text) <= 20 * WORD else _classified.__wrapped__(text)


@lru_cache(HELD_LEAVES)
def _classified(text: str) -> str | None:
    for kind, family in _FAMILIES:
        if family.fullmatch(text):
            return kind
    if text.endswith(_ENDS) and _TAIL.fullmatch(text):
        return "script"
    return "error" if text.startswith('{"') and _ANSWER.match(text) else None


def candidate(line: str) -> str | None:
    """Masked tokens of a line, joined by blanks, if its leaf is open: lines of closed leaves are not read beyond their head."""
    bare = _bare(line).lower()
    tokens, node = bare.split(None, DEPTH), ""
    for place, token in enumerate(tokens[:DEPTH], 1):  # down the tree, as long as the nodes are open
        token = _mask(token)
        long = len(token) > WORD  # a node by its beginning, where the way ends
        node = f"{node} {token[:WORD]}" if node else token[:WORD]
        if is_open(node, not long and len(tokens) > place):
            if long:
                break
        else:
            if bare.endswith(_ENDS) and "without" in bare:
                break
            return None
    if not tokens or _quoted(line):
        return None
    text = " ".join([_mask(t) for t in bare.split()])
    if len(tokens) <= DEPTH and _kind(text) is None:
        return None
    return None if _BARE_WORDS.match(text) and not _WRAPPED.match(line) else text


def judged(line: str) -> str | None:
    """Kind of residue of a whole line by itself."""
    text = candidate(line)
    return _kind(text) if text else None


Template = tuple[str | None, ...]


def _common(lines: Iterable[Template]) -> Template:
    """The tokens in which lines of one length agree, None for the others."""
    return tuple(column[0] if len(set(column)) == 1 else None for column in zip(*lines, strict=True))


def settled(template: Template) -> tuple[bool, str | None]:
    """(whether all lines of a template have the same verdict whatever stands in its gaps, that verdict)."""
    if None not in template:
        return True, _kind(" ".join(template))
    text = " ".join(GAP if t is None else t for t in template)
    head = "".join(f"{t} " for t in template[: template.index(None)])
    for first, family in _FAMILIES:  # in the order in which a line is compared with them
        if family.fullmatch(head, partial=True):
            return (True, first) if family.fullmatch(text) else (False, None)
    ends = text.endswith(_ENDS)
    if ends or template[-1] is None or (template[-2] is None and template[-1].rstrip(".!") == "enabled"):
        return (True, "script") if ends and _TAIL.fullmatch(text) else (False, None)
    if _may_answer(head):
        return (True, "error") if _ANSWER.match(text) else (False, None)
    return True, None


def grouped(lines: Iterable[Template]) -> Iterator[tuple[Template, list[Template]]]:
    """(template, its lines) of the different lines of one leaf: a line joins the group most like it."""
    groups: list[tuple[Template, list[Template]]] = []
    held = letters = 0
    for line in lines:
        best, most = None, ALIKE * len(line)
        for place, (template, _) in enumerate(groups):
            equal = sum(map(eq, line, template))
            if equal >= most and (best is None or equal > most):
                best, most = place, equal
        if best is None:
            groups.append((line, [line]))
        else:
            template, members = groups[best]
            members.append(line)
            if most < len(line) - template.count(None):
                groups[best] = tuple(a if a == b else None for a, b in zip(template, line, strict=True)), members
        held, letters = held + 1, letters + sum(map(len, line))
        if len(groups) > HELD_GROUPS:
            yield groups.pop(0)
        if held >= 2 * HELD_LINES or letters >= HELD_LETTERS:
            yield from groups
            groups, held, letters = [], 0, 0
    yield from groups


def mined(lines: Iterable[Template]) -> Iterator[tuple[Template, str | None, list[Template]]]:
    """(template, kind, its lines) of the different lines of one leaf; a template that is not settled is split at its first gap."""
    for group in grouped(lines):
        todo = [group]
        while todo:
            template, members = todo.pop()
            sure, kind = settled(template)
            if sure:
                yield template, kind, members
                continue
            gap, parts = template.index(None), {}
            for line in members:
                parts.setdefault(line[gap], []).append(line)
            todo.extend((_common(part), part) for part in parts.values())


def _shown(template: Template) -> str:
    return " ".join("<*>" if t is None else t for t in template)


#: Tags whose text stands for the whole page, and what pieces are cut at.
_TITLES = frozenset(("title", "h1", "h2"))
_CUT = re.compile(r"<(/?[A-Za-z!][A-Za-z0-9]*)(?:\s[^<>]*)?/?>|(?<=[.!?:;])\s+")


def _pieces(line: str) -> Iterator[tuple[str, str]]:
    """(tag the piece follows, lower case, or blank; piece) of a line cut at tags and ends of sentences."""
    at, tag = 0, ""
    for cut in _CUT.finditer(line):
        if piece := line[at : cut.start()].strip():
            yield tag, piece
        at = cut.end()
        if cut[1] is not None:
            tag = cut[1].lower()
    if piece := line[at:].strip():
        yield tag, piece


#: What may be a message: (place in its line, masked text, whether it counts alone, whether it does as a script notice).
#: A piece without a text is an error as it stands.
Piece = tuple[int, str | None, bool, bool]


def run_on(line: str) -> list[Piece]:
    """Pieces of a line that may be messages, if enough to make it residue: see the module's docstring."""
    markup = line.lstrip()[:1] == "<"
    page = line.lstrip()[:9].lower().startswith(("<!doctype", "<html", "<head", "<body", "<title"))
    found: list[Piece] = []
    for place, (tag, piece) in enumerate(_pieces(line)):
        titled = page and tag in _TITLES
        if titled and len(piece) <= WORD and _kind_of_name(piece):
            found.append((place, None, True, False))
        elif text := candidate(piece):
            found.append((place, text, titled or (place == 0 and not markup), tag == "noscript"))
    enough = any(alone or script for _, _, alone, script in found) or any(b[0] == a[0] + 1 for a, b in pairwise(found))
    return found if enough else []


def told(pieces: Iterable[tuple[int, str, bool, bool]]) -> str | None:
    """Kind of residue of a line by those of its pieces that are messages, in order, with their kinds in place of texts."""
    before = None
    for place, kind, alone, script in pieces:
        if alone or before == place - 1 or (script and kind == "script"):
            return kind
        before = place
    return None


@lru_cache(HELD_LEAVES)
def _kind_of_name(piece: str) -> bool:
    """Whether a title is nothing but the name of an error status."""
    return bool(_NAME_ALONE.fullmatch(piece.lower()))


_NAME_ALONE = re.compile(rf"(?:error:? )?{_STATUS_NAME}[.!]?")


def _quoted(line: str) -> bool:
    if line.lstrip().startswith('{"'):
        return False
    return "`" in line or '"' in line or line.lstrip().startswith(("//", "--", "///", "/*")) or line.rstrip().endswith((";", "{"))


def filler(line: str) -> bool:
    """Invented Latin, keyboard mash, or the same few words again and again."""
    words = _WORDS.findall(line.lower())
    n = len(words)
    if n < 4 or _quoted(line):
        return False
    phrases = [" ".join(_WORDS.findall(p)) for p in re.split(r"[.,;!?]+", line.lower())]
    phrases = [p for p in phrases if p]
    if len(phrases) > 1 and len(set(phrases)) == 1 and 2 <= phrases[0].count(" ") + 1 <= 4 and len(phrases[0]) >= 8:
        return True
    letters = sum(map(len, words))
    if n >= 8 and len(set(words)) <= 4 and letters >= 24:  # a sentence said twice has more different words
        return True
    if letters >= 25 and sum(map(bool, map(_MASHED.match, words))) == n and "=" not in line:
        return True
    return letters / n >= 4.5 and _mostly_latin(words)


def _mostly_latin(words: list[str]) -> bool:
    """Whether four in five words are invented Latin; ordinary text is told by its first words."""
    spare = len(words) - 0.8 * len(words)
    for w in words:
        if len(w) > WORD or not _is_latin(w):
            spare -= 1
            if spare < 0:
                return False
    return True


@lru_cache(HELD_LEAVES)
def _is_latin(word: str) -> bool:
    return bool(_LATIN_WORD.fullmatch(word))


def open_slot(line: str, text: str) -> bool:
    """A slot that stands where content should be: alone, behind a label, or in a short sentence outside code."""
    found = [m for m in _SLOT.finditer(line) if _is_slot(m[0], text)]
    if not found:
        return False
    rest = line
    for m in found:
        rest = rest.replace(m[0], "\x00")
    if _CODE.search(rest) or line.lstrip().startswith(("//", "--", "/*")):
        return False
    bare = _bare(rest).strip(" .,:()*_-!")
    if not bare.strip("\x00 .,:()*_-/|"):
        return True
    label, colon, value = bare.partition(":")
    if colon and _LABEL.match(label.strip("*_ ")) and not value.strip("\x00 *_"):
        return True
    words = _WORDS.findall(rest)
    return len(words) <= 6 * len(found) and len(words) <= 24


def _is_slot(slot: str, text: str) -> bool:
    if slot[0] == "<" and slot[1] != "%":
        name = slot[1:-1]
        return not _CAMEL.search(name) and (name.islower() or name.isupper() or " " in name or "-" in name) and f"</{name}" not in text and "<?xml" not in text and not _HTML.match(name)
    if slot[0] == "{" and slot[1] != "{" and slot[1] != "%":
        return not _CAMEL.search(slot)
    return True


_HTML = re.compile(r"(?:html|head|body|br|hr|p|li|ul|ol|td|tr|div|span|pre|code|b|i|em|strong|a|table|img|input|title)$", re.I)


def lines_of(text: str) -> Iterator[str]:
    """Lines outside fenced code. A fence that is never closed fences nothing."""
    held: list[str] | None = None
    for line in text.splitlines():
        if line.lstrip().startswith("```"):
            held = [] if held is None else None
        elif line.strip():
            if held is None:
                yield line
            else:
                held.append(line)
    yield from held or ()


def _empty_list(text: str) -> bool:
    """A numbered list without entries under a heading."""
    run = 0
    for line in text.splitlines():
        run = run + 1 if _NUMBERED.match(line.strip()) else 0
        if run >= 3:
            return True
    return False


def parts_of(text: str) -> tuple[bool, list[list[Piece]]]:
    """(whether a text has slots, filler or empty lists; the lines that may be messages, each as its pieces)."""
    slot, found = False, []
    may_slot = _SLOT.search(text) is not None
    for line in lines_of(text):
        start = line.lstrip()[:2]
        long = len(line) > 2 * RUN_ON and start != '{"' and len(line.split(None, RUN_ON)) > RUN_ON
        if not long and (own := candidate(line)):
            found.append([(-2, own, True, False)])  # next to no piece
        if (long or start[:1] == "<") and (pieces := run_on(line)):
            if not long and own:  # read in pieces only if it is no message as a whole
                pieces = found.pop() + pieces
            found.append(pieces)
        slot = slot or (may_slot and open_slot(line, text)) or filler(line)
    return slot or _empty_list(text), found


def kinds_of(text: str) -> set[str]:
    """Kinds of residue in a text; `slot` stands for slots, filler and empty lists."""
    slot, found = parts_of(text)
    lines = sorted({tuple(own.split(" ")) for pieces in found for _, own, _, _ in pieces if own}, key=lambda line: (*leaf(line), line))
    kinds: dict[str | None, str] = {None: "error"}
    for _, same in groupby(lines, leaf):
        for _, kind, members in mined(same):
            if kind:
                kinds.update((" ".join(line), kind) for line in members)
    own = {told((place, kinds[text], alone, script) for place, text, alone, script in pieces if text in kinds) for pieces in found}
    return (own - {None}) | ({"slot"} if slot else set())


_PIECES = "array<struct<place int, own string, alone boolean, script boolean>>"
_PIECES_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("own", pa.string()), ("alone", pa.bool_()), ("script", pa.bool_())]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, slot, pieces): a row per line that may be a message, and one per document with slots."""
    for batch in batches:
        ids, slots, lines = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            slot, found = parts_of(text.as_py())
            for pieces in [[]] * slot + found:
                ids.append(doc)
                slots.append(not pieces)
                lines.append([dict(zip(("place", "own", "alone", "script"), p, strict=True)) for p in pieces])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(slots, pa.bool_()), pa.array(lines, _PIECES_ARROW)], names=["doc_id", "slot", "pieces"])


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, n, template, kind) of the lines that are messages; rows of a leaf follow each other."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    held: list[tuple] = []
    for _, same in groupby(rows(), lambda r: r[:3]):
        n_lines: dict[Template, int] = {}

        def lines(same=same, n_lines=n_lines) -> Iterator[Template]:
            for *_, own, n in same:
                line = tuple(own.split(" "))
                n_lines[line] = n
                yield line

        for template, kind, members in mined(lines()):
            counts = [n_lines.pop(line) for line in members]
            if kind:
                shown = _shown(template)
                held.extend((" ".join(line), n, shown, kind) for line, n in zip(members, counts, strict=True))
                if len(held) >= HELD_LINES:
                    yield _messages(held)
                    held = []
    if held:
        yield _messages(held)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    own, n, template, kind = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(n, pa.int64()), pa.array(template), pa.array(kind)], names=["own", "n", "template", "kind"])


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, kind) of the lines that are residue by their messages."""
    for batch in batches:
        ids, kinds = [], []
        for doc, pieces in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if kind := told(tuple(p.values()) for p in pieces.as_py()):
                ids.append(doc)
                kinds.append(kind)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds)], names=["doc_id", "kind"])


def _pieces_of(documents: DataFrame) -> DataFrame:
    """(doc_id, unit, slot, pieces): texts read once, what may be a message kept."""
    docs = documents.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(docs.mapInArrow(_read, f"doc_id long, slot boolean, pieces {_PIECES}").withColumn("unit", F.monotonically_increasing_id()), "pieces")


def _messages_of(units: DataFrame) -> DataFrame:
    """(own, n, template, kind): the different lines that are messages, by one tree for the whole corpus.

    A leaf of more than HELD_LINES different lines is mined in parts of about so many, by the hashes of its lines.
    """
    lines = units.select(F.explode("pieces.own").alias("own")).where("own is not null").groupBy("own").agg(F.count("*").alias("n"))
    lines = stored(lines.select(F.size(F.split("own", " ")).alias("size"), F.substring_index("own", " ", DEPTH).alias("head"), "own", "n"), "lines")
    large = F.broadcast(lines.groupBy("size", "head").agg(F.count("*").alias("lines")).where(F.col("lines") > HELD_LINES))
    part = F.coalesce(F.pmod(F.xxhash64("own"), F.ceil(F.col("lines") / HELD_LINES)), F.lit(0)).alias("part")
    placed = lines.join(large, ["size", "head"], "left").select("size", "head", part, "own", "n")
    leaves = placed.repartition("size", "head", "part").sortWithinPartitions("size", "head", "part", "own")
    return stored(leaves.mapInArrow(_mine, "own string, n long, template string, kind string"), "messages")


def templates(documents: DataFrame) -> DataFrame:
    """(template, kind, n_lines): the different message lines of the corpus, masked, each with its number of lines."""
    return _messages_of(_pieces_of(documents.withColumn("doc_id", F.lit(0)))).groupBy(F.col("own").alias("template"), "kind").agg(F.sum("n").alias("n_lines"))


def merged_templates(documents: DataFrame) -> DataFrame:
    """(template, kind, n_lines): the templates that are messages, `<*>` where their lines differ, each with its number of lines."""
    return _messages_of(_pieces_of(documents.withColumn("doc_id", F.lit(0)))).groupBy("template", "kind").agg(F.sum("n").alias("n_lines"))


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds): documents with residue, and which kinds; `slot` stands for slots and filler.

    Null, empty and blank texts are none. Repeated rows count once. Texts are read in one pass, where they
    lie; only lines of open leaves and the documents found are shuffled.
    """
    units = _pieces_of(documents.where("doc_id is not null"))
    messages = _messages_of(units)
    pieces = units.select("doc_id", "unit", F.explode("pieces").alias("p")).select("doc_id", "unit", "p.*")
    kinds = messages.select("own", "kind")
    if input_bytes(messages) <= BROADCAST_BYTES:
        met = pieces.join(F.broadcast(kinds), "own")
    else:
        met = salted_join(pieces, kinds, ["own"], messages, "n", F.xxhash64("unit"))
    shape = ["doc_id", "unit", "place", "kind", "alone", "script"]
    met = met.select(*shape).unionByName(pieces.where("own is null").withColumn("kind", F.lit("error")).select(*shape))
    units_met = met.repartition("doc_id").groupBy("doc_id", "unit").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "alone", "script"))).alias("pieces"))
    found = units_met.select("doc_id", "pieces").mapInArrow(_tell, "doc_id long, kind string").unionByName(units.where("slot").select("doc_id", F.lit("slot").alias("kind")))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def p8_found(spark, folder):
    from strataquery.sources.tables import spread, table

    return residue(spread(table(spark, folder, "documents", "doc_id", "text"))).select("doc_id")
