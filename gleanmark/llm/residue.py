"""Template residue, filler and error pages in the fields of captured records.

Records of one template are aligned by what they have in common. A passage that holds a span like a slot (a variable's name
between marks of any kind, a value that failed to render) is cut into constant text and slots; passages of the same constant
text are one template, whose slots are thereby induced, and a slot is judged by what it holds: a variable's name, a default,
a failed value. What such slots hold becomes known, so that a field that holds nothing else is found as well. The constant
text of repeated templates is then looked for in all passages: a record of the template whose slot is blank, or whose slots
all hold the same default, is found although no mark is left in it. Without a second record to align, a slot counts only in
a syntax that is known.

Filler, error messages and notices are told by their words. A passage that is mostly such words is a case; one that holds
them among others must repeat as a template over several records, addresses and numbers apart. Spans in quotes or backticks
are examples, not slots, and passages that explain or quote such words aren't cases.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmark.session import staged

#: Records that a template of a weak notice, or one that blanks are looked for in, must be found in.
LEAST_REPEATS = 3
#: Share of a passage that its notice or filler must make up to count without repeating.
LEAST_SHARE = 0.2
#: Templates that one pass over the records looks for; all others have further passes, so none is left out.
MOST_FRAMES = 20_000
#: Characters of a template's constant text that it is found by, before all of it is compared.
LEAD = 48
SLOT = "␀"

# The syntaxes of unfilled slots. What stands between marks may be of any length.
_STRONG = (
    r"\{\{\{?[^{}\n]*\}?\}\}|\{%[^%{}\n]+%\}|<%=?[^%\n]+%>|[$#]\{[\w.\- ]+\}|\{[a-zA-Z_]\w*(?:\.\w+)*\}|\[\[[^\[\]\n]+\]\]|%[A-Z][A-Z_]{2,}%|%\d\$[sd]"
    r"|__[A-Za-z][A-Za-z_]+__|@@\w{2,}@@|\$\$[a-zA-Z_]{2,}\$\$|\[(?:INSERT|ENTER|YOUR|ADD|PLACEHOLDER|TITLE|NAME|DATE)\b[A-Z0-9 _-]*\]|<(?:YOUR|INSERT|ENTER)[A-Z0-9 _-]+>|\[object \w+\]|\b(?:TODO|FIXME|TBD): ?\w+(?: \w+)?|\b[A-Z]{3,}_HERE\b|<!-- ?\w+ ?-->"
)
_WEAK = r"«[A-Z][A-Za-z_]+»|‹[A-Z][A-Za-z_]+›|<[a-zA-Z_]{3,}>|\{\d{1,2}\}|%[sd](?![A-Za-z0-9_%])|(?<![A-Za-z0-9_])(?:undefined|NaN|null|None|nil)(?![A-Za-z0-9_])|#(?:REF|VALUE|NAME|N/A)[!?]?|\.\.\.loading\.\.\.|…loading…"
# Filler, in en, de, fr, es, pt and zh.
_FILLER = (
    r"lorem ipsum dolor|dolor sit amet|consectetur adipisci|(?:placeholder|dummy|filler) (?:paragraph|text|copy|content)|your (?:text|content|headline|title) (?:goes )?here|sample (?:headline|title|text)[^.]{0,24}(?:demo|purposes)|enter (?:a )?description|describe (?:the|your) \w+ here|(?:type|insert|add) (?:your )?text here|replace before publishing"
    r"|hier steht ihr text|blindtext|platzhaltertext|beispielüberschrift|beschreibung eingeben|ihr text hier|texte? de remplissage|faux[- ]texte|votre texte ici|titre d.exemple|saisir la description|saisissez"
    r"|texto de relleno|su texto aquí|titular de muestra|escriba la descripción|texto de preenchimento|seu texto aqui|título de amostra|digite a descrição|占位文字|此处填写|示例标题|请输入描述|在此输入"
    r"|\b(?:asdf ?){2,}|\b(?:qwerty ?){2,}|^(\w{2,})(?: \1){2,}\W*$|\b(?:test ){2,}\d*|\bx{4,}(?: x{4,})*\b|\bfoo bar baz\b|\bnull null\b"
)
# Messages of error pages and script notices.
_ERROR = (
    r"\b(?:4\d\d|50\d)[ :–-]*(?:error[ :–-]*)?(?:not found|bad gateway|bad request|internal server error|service (?:temporarily )?unavailable|gateway time-?out|forbidden|unauthori[sz]ed|too many requests|gone\b|nicht gefunden|interner serverfehler|page introuvable|no encontrad|não encontrad|您访问的页面)"
    r"|internal server error|bad gateway|gateway time-?out|service temporarily unavailable|page not found|page (?:you (?:asked|requested|are looking|were looking)[^.]{0,12}|requested )(?:does not|doesn.t|could not|has been|was not|cannot)|(?:this|the) (?:content|page) is (?:no longer|not|currently un)\s?available|access denied|(?:do not|don.t) have permission to (?:view|access|see)|too many requests|something went wrong|our engineers have been notified|fatal error: ?\w+|uncaught \w*error|upstream connect error|connection (?:timed out|refused|reset)|maintenance in progress|traceback \(most recent"
    r"|seite (?:wurde )?nicht gefunden|angeforderte seite|inhalt ist nicht (?:mehr )?verfügbar|zugriff verweigert|zu viele anfragen|ist etwas schiefgelaufen|interner serverfehler|technik wurde informiert|page (?:est )?introuvable|page demandée n.existe|contenu n.est (?:plus|pas) disponible|accès refusé|trop de requêtes|une erreur est survenue|erreur interne du serveur"
    r"|página no encontrada|página solicitada no existe|contenido (?:ya )?no está disponible|acceso denegado|demasiadas (?:peticiones|solicitudes)|algo ha salido mal|error interno del servidor|página não encontrada|página pedida não existe|conteúdo não está (?:mais )?disponível|acesso negado|muitas (?:solicitações|requisições)|algo deu errado|erro interno do servidor"
    r"|页面(?:找不到|不存在|未找到)|页面不存在或已被|内容已?不可用|拒绝访问|请求过多|系统出错|服务器内部错误|没有权限(?:查看|访问)"
)
_SCRIPT = (
    r"(?:enable|activate|turn on|switch on|need to turn on|allow|requires?|needs?|without) (?:javascript|scripts?|js)\b|(?:javascript|scripts?) (?:(?:is|are|seems to be) )?(?:required|disabled|switched (?:on|off)|turned off|must be enabled)|javascript (?:seems|is) [^.]{0,12}disabled|does not support (?:javascript|scripts?)|best with javascript"
    r"|javascript (?:aktivier|einschalt|erforderlich)|(?:aktivieren|benötigt|erfordert|braucht)[^.]{0,20}(?:javascript|skripte)|skripte (?:ausgeschaltet|deaktiviert|blockiert)|ohne javascript|skripte ausgeschaltet|(?:activ|exige|nécessite|requiert)\w*[^.]{0,12}javascript|scripts (?:sont )?désactivés"
    r"|(?:active|activ[ae]r|necesita|requiere|habilite)[^.]{0,10}javascript|scripts desactivados|(?:ative|ativar|precisa de|requer|habilite)[^.]{0,6}javascript|scripts desligados|(?:启用|开启|需要|打开) ?(?:javascript|脚本)|(?:禁用|关闭)了?(?:javascript|脚本)"
)
# Words of passages that explain or quote.
_EXPLAINS = re.compile(r"(?i)\b(?:explains?|explained|means?|example|literal|joke|tutorial|course|types? `|handbook|manual|erklärt|bedeutet|meint|beispiel|zitiert|scherz\w*|tippt|explique|signifie|signale|exemple|plaisant\w*|explica|significa|indica|ejemplo|bromea\w*|exemplo|brinca\w*)\b|解释|表示|例子|演示|开玩笑")
_QUOTED = re.compile(r"`[^`\n]{0,120}`|“[^”\n]{0,160}”|„[^“”\n]{0,160}[“”]|\"[^\"\n]{0,160}\"|«\s[^»\n]{0,160}\s»|«[^»\n]*[^A-Za-z_»\n][^»\n]*»|「[^」\n]{0,120}」|『[^』\n]{0,120}』|‘[^’\n]{0,80}’")
# A name between marks of any syntax: letters right between marks that don't belong to ordinary punctuation.
_MARK = r"[^\w\s.,;:!?'\"()\-–—…“”„«»‘’/&©·•€£°、。，；：！？（）「」『』《》]"
_ANY = rf"(?<![\w]){_MARK}{{1,3}}[^\W\d][\w.-]*{_MARK}{{1,3}}(?![\w])"
_STRONG_RE, _WEAK_RE, _ANY_RE = re.compile(_STRONG), re.compile(_WEAK), re.compile(_ANY)
_SLOT_RE = re.compile(f"(?P<known>{_STRONG})|(?P<failed>{_WEAK})|{_ANY}")
_NOTICE_RE = re.compile(f"(?:{_ERROR}|{_SCRIPT})", re.I)
_FILLER_RE = re.compile(_FILLER, re.I)
# Addresses, hosts and paths of a notice, which vary between records of one template.
_ADDRESS_RE = re.compile(r"\b\w+://[^\s<>\"]+|\b[\w-]+(?:\.[\w-]+)+(?::\d+)?(?:/[^\s<>\"]*)?|(?<!\w)/[\w./%?=&-]+")
_REPEATED_RE = re.compile(r"(\w{2,})(?: \1){2,}\W*$", re.I)
_SLOTS = re.compile(rf"{SLOT}(?:\s*{SLOT})*")
_SPLIT = re.compile(r"\n|(?<=[.!?])\s+(?=[A-ZÀ-Þ¿¡\[{<$%#_@«])|(?<=[。！？])")
# A passage without one of these or of LOREM (in lower case) and without a repeated word holds no candidate.
# Each alternative of the patterns above needs one.
HINTS = (
    "{ [[ <% <! <your < [insert [enter [your [add [title [name [date [placeholder [object @@ $$ ${ #{ __ % « ‹ undefined nan null none nil #ref #value #name #n/a ...loading …loading todo fixme tbd _here "
    "lorem dolor consectetur adipisc eiusmod incididunt placeholder dummy filler goes describe&the describe&your sample description publishing steht blindtext platzhalter beispielüberschrift eingeben remplissage faux votre exemple saisir saisissez relleno texto muestra escriba preenchimento amostra digite "
    "占位文字 此处填写 示例标题 请输入描述 在此输入 asdf qwerty xxxx test&test text&text foo&bar text&here content&here headline&here title&here text&hier "
    "not&found bad&gateway bad&request server&error unavailable gateway&time forbidden unauthor too&many&requests gefunden serverfehler introuvable encontrad page&you page&requested page&does gone available access&denied permission went&wrong notified fatal&error uncaught upstream connection maintenance traceback "
    "angeforderte verfügbar verweigert anfragen schiefgelaufen technik&wurde demandée disponible refusé requêtes erreur solicitada disponible denegado demasiadas salido&mal error&interno pedida disponível negado muitas errado erro&interno "
    "您访问的页面 找不到 不存在 未找到 不可用 拒绝访问 请求过多 系统出错 服务器内部 没有权限 javascript script &js skript 脚本"
)
# Words of the Latin filler that no other language here has.
LOREM = frozenset("lorem ipsum dolor dolore amet consectetur adipiscing elit eiusmod tempor incididunt labore aliqua veniam nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit laborum magna minim".split())


@functools.lru_cache(maxsize=1)
def _hints():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for h in (*HINTS.split(), *LOREM):
        automaton.add_word(h.replace("&", " "), 1)
    automaton.make_automaton()
    return automaton


def _hinted(text: str) -> bool:
    return next(_hints().iter(text.lower()), None) is not None


def _doubled(text: str) -> bool:
    """Whether a word follows itself, as at the start of filler that repeats one word."""
    words = text.lower().replace("。", " ").replace("！", " ").replace("？", " ").split()
    return any(map(operator.eq, words, itertools.islice(words, 1, None)))


def passages(text: str, field: str) -> list[str]:
    return [p for p in (s.strip() for s in (_SPLIT.split(text) if field == "text" else [text])) if p]


def _latin_filler(passage: str) -> bool:
    words = re.findall(r"[a-z]+", passage.lower())
    known = sum(w in LOREM for w in words)
    return known >= 3 and known >= 0.6 * len(words)


def judge(passage: str) -> tuple[str, list[str], str] | None:
    """Template of a passage, what its slots hold, and the evidence; None where nothing is found.

    Evidence of slots: ``name`` (a known syntax), ``failed`` (a value that failed to render, alone in the passage), ``mark`` (a
    failed value or another mark among other text). Of other passages: ``says`` (mostly notice or filler), ``mentions``.
    """
    bare = _QUOTED.sub(" ", passage)
    slots = list(_SLOT_RE.finditer(bare))
    if slots:
        template = re.sub(r"\d+", "0", _SLOT_RE.sub(SLOT, bare)).strip()
        if any(m["known"] for m in slots):
            evidence = "name"
        elif any(m["failed"] for m in slots) and (not re.search(r"\w", template) or slots[0].group().strip(".…") == bare.strip(" .…")):
            evidence = "failed"
        else:
            evidence = "mark"
        return template, [m.group() for m in slots], evidence
    spoken = [m.end() - m.start() for m in (*_NOTICE_RE.finditer(bare), *_FILLER_RE.finditer(bare))]
    latin = _latin_filler(bare)
    if spoken or latin:
        masked = _ADDRESS_RE.sub("0", bare)
        share = 1.0 if latin else sum(spoken) / len(bare)
        if share < 0.5 and _EXPLAINS.search(masked):
            return None
        says = share >= LEAST_SHARE
        return re.sub(r"\d+", "0", masked), [], "says" if says else "mentions"
    return None


def candidates(text: str, field: str) -> list[tuple[str, tuple[str, ...], str]]:
    if not _hinted(text) and not _doubled(text) and not _ANY_RE.search(text):
        return []
    found = (judge(p) for p in passages(text, field) if _hinted(p) or _REPEATED_RE.match(p) or _ANY_RE.search(p))
    return [(t, tuple(held), e) for t, held, e in filter(None, found)]


def _proposed(rows: DataFrame) -> DataFrame:
    """``content_id, field_name, template, held, evidence`` of the suspicious passages of ``content_id, field_name, value``."""
    kind = dict(rows.dtypes)["content_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            ids, fields = batch.column(0), batch.column(1).to_pylist()
            for k, value in enumerate(batch.column(2).to_pylist()):
                for template, held, evidence in dict.fromkeys(candidates(value, fields[k])):
                    for column, x in zip(out, (ids[k].as_py(), fields[k], template, list(held), evidence)):
                        column.append(x)
            kinds = (batch.schema.field(0).type, pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["content_id", "field_name", "template", "held", "evidence"])

    return rows.mapInArrow(run, f"content_id {kind}, field_name string, template string, held array<string>, evidence string")


def _pieces(template: str) -> list[str]:
    """The constant text around the slots, with single spaces. Slots with nothing between them are one."""
    return [" ".join(p.split()) for p in _SLOTS.split(template)]


def constant(template: str) -> str | None:
    """The longest constant text without numbers, which every record of the template holds; None if no piece has two words
    besides numbers, so that it would be met by chance."""
    pieces = _pieces(template)
    if len(pieces) < 2 or not any(sum("0" not in w for w in p.split()) > 1 or len(re.findall(r"[一-鿿]", p)) > 1 for p in pieces):
        return None
    return max((x.strip() for p in pieces for x in p.split("0")), key=len)


@functools.lru_cache(maxsize=10_000)
def pattern(template: str) -> re.Pattern:
    """What the records of a template match; groups hold what their slots do."""
    words = [r"\s+".join(re.sub(r"0+", r"\\d+", re.escape(w)) for w in p.split()) for p in _pieces(template)]
    return re.compile(r"^\s*" + r"\s*(.*?)\s*".join(words) + r"\s*$")


def _looks_blank(held: tuple[str, ...]) -> bool:
    """Whether the slots of an aligned record hold nothing, or all of several the same default."""
    values = [h.strip(" .,;:!?，。；：！？") for h in held]
    return not all(values) or (len(values) > 1 and len({v.lower() for v in values}) == 1)


def _frames(templates: DataFrame) -> Iterator[list[str]]:
    """The templates that have enough constant text, as many at a time as one pass looks for."""
    own = (r.template for r in templates.toLocalIterator() if constant(r.template))
    while part := list(itertools.islice(own, MOST_FRAMES)):
        yield part


def _blank(rows: DataFrame, frames: list[str]) -> DataFrame:
    """``content_id, field_name`` of the records of templates whose slots are blank or hold a default."""
    kind = dict(rows.dtypes)["content_id"]
    shared = rows.sparkSession.sparkContext.broadcast(frames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        of: dict[str, list[tuple[str, str]]] = {}
        for template in shared.value:
            c = constant(template)
            of.setdefault(c[:LEAD], []).append((c, template))
        for lead in of:
            automaton.add_word(lead, lead)
        automaton.make_automaton()

        def blank(value: str, field: str) -> bool:
            spaced = " ".join(value.split())
            met = [x for lead in {lead for _, lead in automaton.iter(spaced)} for x in of[lead] if x[0] in spaced]
            return bool(met) and any(m and _looks_blank(m.groups()) for p in passages(value, field) for c, template in met if c in " ".join(p.split()) for m in [pattern(template).match(p)])

        for batch in batches:
            fields = batch.column(1).to_pylist()
            keep = pa.array([blank(v, f) for v, f in zip(batch.column(2).to_pylist(), fields)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    return rows.mapInArrow(run, f"content_id {kind}, field_name string")


def _fields(content: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    value = {"text": F.array("text"), "limitations": F.col("limitations") if "limitations" in content.columns else None, "status": F.array("status") if "status" in content.columns else None}
    tagged = lambda name: lambda v: F.struct(F.lit(name).alias("field_name"), v.alias("value"))
    named = [F.transform(value[f], tagged(f)) for f in fields]
    empty = F.array().cast("array<struct<field_name:string,value:string>>")
    rows = content.where("content_id is not null").select("content_id", F.inline(F.flatten(F.array(*[F.coalesce(n, empty) for n in named]))))
    return rows.where("value is not null and trim(value) <> ''")


def evidence(content: DataFrame, fields: tuple[str, ...] = ("text", "limitations", "status")) -> DataFrame:
    """``content_id, field_name, evidence``: what showed each case: ``aligned`` (a slot of a template that several records
    have), ``held`` (nothing but what such slots hold), ``blank`` (a slot left empty or at its default), ``syntax`` (a slot
    of a known syntax in a single record), ``notice`` (filler, an error message or a script notice).
    """
    rows = _fields(content, fields)
    # Few passages are suspicious; written once, they aren't looked for again by each of the reads below.
    found = staged(_proposed(rows).distinct(), "passages")
    slots = found.where("evidence in ('name', 'failed', 'mark')")
    constant = F.regexp_replace("template", SLOT, "").rlike("\\w")
    per = slots.where(constant).groupBy("template").agg(F.countDistinct("content_id").alias("n"), F.max(F.col("evidence") == "name").alias("named"))
    # A template holds slots if one of its records has a known one, or if it repeats as a notice must.
    templates = staged(per.where(f"n > 1 and (named or n >= {LEAST_REPEATS})"), "templates")
    aligned = slots.join(templates.select("template"), "template", "left_semi")
    # Values that slots of several templates hold are no text.
    held = aligned.select("template", F.explode("held").alias("value")).groupBy("value").agg(F.countDistinct("template").alias("n")).where("n > 1").select("value")
    alone = slots.where(~constant).select("content_id", "field_name", "evidence", F.explode("held").alias("value")).join(held.withColumn("is_held", F.lit(True)), "value", "left")
    single = slots.where("evidence = 'name'").join(templates.select("template"), "template", "left_anti")
    notices = found.where("evidence in ('says', 'mentions')")
    repeated = notices.where("evidence = 'mentions'").groupBy("template").agg(F.countDistinct("content_id").alias("n")).where(F.col("n") >= LEAST_REPEATS).select("template")
    tagged = lambda df, name: df.select("content_id", "field_name", F.lit(name).alias("evidence"))
    parts = [
        tagged(aligned, "aligned"),
        tagged(alone.where("is_held or evidence = 'failed'"), "held"),
        tagged(single, "syntax"),
        tagged(notices.where("evidence = 'says'"), "notice"),
        tagged(notices.where("evidence = 'mentions'").join(repeated, "template", "left_semi"), "notice"),
    ]
    frames = templates.where(F.col("n") >= LEAST_REPEATS).select("template")
    parts.extend(tagged(_blank(rows, part), "blank") for part in _frames(frames))
    return functools.reduce(DataFrame.unionByName, parts)


def residue(content: DataFrame, fields: tuple[str, ...] = ("text", "limitations", "status")) -> DataFrame:
    """``content_id, field_name``: the fields that hold residue, filler, error messages or script notices, each once.

    Null, empty and blank fields and entries are no cases, nor are other spellings of a status. Records that arrived
    twice count once for the repeats of a template. Extra columns are ignored.
    """
    return evidence(content, fields).select("content_id", "field_name").distinct()


def real_text(content: DataFrame) -> DataFrame:
    """The records whose text is neither null nor blank and no case of ``residue``."""
    # A written table has a known size: Spark broadcasts it only below its threshold and shuffles beyond.
    cases = staged(residue(content.select("content_id", "text"), ("text",)).select("content_id"), "residue")
    return content.where("text is not null and trim(regexp_replace(text, '[\\\\s\\u00a0\\u3000]+', ' ')) <> ''").join(cases, "content_id", "left_anti")
