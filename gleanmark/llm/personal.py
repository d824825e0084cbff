"""Personal information in free text.

Three steps for each text: regular expressions propose typed spans; checksum validators confirm identity numbers
(Luhn, mod 97, mod 11 and the like); words near a span raise or lower its score. Spans at or above ``ACCEPT`` count,
the better one where two overlap. ``redact`` puts typed placeholders in their place and leaves the rest as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmark.operators.nested import comments_of

KINDS = ("email", "phone", "id_number", "address", "name")
ACCEPT = 1.0
#: Characters before and after a span in which context words count.
WINDOW = 42

# Words that make a kind more or less likely nearby, in en, de, fr, es, pt and zh.
PHONE_WORDS = r"call|phone|ring|text|mobile|cell|tel|whatsapp|sms|reach|dial|fax|hotline|my number|number is|ruf|anruf\w*|telefon|handy|nummer|erreich\w*|appel\w*|téléphone|portable|numéro|joign\w*|llám\w*|llama\w*|teléfono|móvil|mensaje|número|lig\w+|telefone|celular|mensagem|zap|电话|手机|致电|拨打|短信|联系方式|号码"
ID_WORDS = r"ssn|social security|tax|passport|national id|my id|identity|insurance number|on the form|at the counter|belongs to me|ausweis\w*|steuer\w*|sozialversicherung\w*|personal\w*|gehört mir|carte d.identité|fiscal|sécu\w*|identité|passeport|dni|nif|nie|identidad|pasaporte|seguridad social|cpf|cnpj|rg|documento|contribuinte|cartão|身份证|证件|护照|社保|税号|iban|account number|card"
NOT_PERSONAL = r"isbn|issn|version|versión|versão|ticket|order|pedido|commande|bestell\w*|invoice no|model|modelo|modèle|modell|serial|art\.|sku|ref\.|编号|型号|版本|订单|价|元"
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Herrn|Frau|Monsieur|Madame|Mme|Mlle|M\.|Señor|Señora|Sr|Sra|Srta|Don|Doña|Senhor|Senhora|Dona|Dom"
GIVEN = "Adam Adrian Ahmed Alan Alba Alejandro Alex Alexander Alexandra Alfred Alice Alicia Amanda Ana Andre André Andrea Andreas Andrew Angela Anita Anke Anna Anne Annika Antoine Antonio Arthur Astrid Aurora Axel Barbara Beate Beatriz Ben Benjamin Bernard Bernd Bianca Birgit Brian Bruno Camila Camille Carla Carlos Carmen Caroline Catarina Catherine Cecilia Charles Charlotte Chiara Chloe Chris Christian Christina Claire Clara Claudia Claude Clemens Cristina Dagmar Daniel Daniela David Denis Diana Diego Dieter Dirk Dominique Dora Duarte Eduardo Elena Elias Elisa Elisabeth Elise Elizabeth Ella Emil Emilia Emily Emma Eric Erik Erika Ernst Esther Eva Fabian Felipe Felix Fernando Filipe Finn Florian Frank Franz François Friedrich Gabriel Gabriela George Georg Gerd Greta Guillaume Gustav Hanna Hannah Hans Harald Heike Heinz Helen Helena Hélène Helga Henri Henrik Henry Hugo Ida Igor Ines Inês Ingrid Irene Iris Isabel Isabelle Ivan Jack Jakob James Jan Jana Jane Javier Jean Jens Joana Joanna João Johanna Johannes John Jonas Jorge José Josef Joseph Juan Julia Julian Julie Julien Juliette Jürgen Karin Karl Katharina Katja Klara Klaus Lara Laura Lea Léa Lena Leo Leon Lina Linda Lisa Lorenzo Louis Louise Luca Lucas Lucia Lucía Lucie Luis Luísa Lukas Luisa Lydia Magda Manfred Manuel Marc Marco Marcus Margarida Maria María Marie Marina Mario Marion Markus Marta Martha Martin Martina Mary Mateo Mathilde Matteo Matthias Max Maya Mia Michael Michel Miguel Mila Mona Monika Nadia Nathalie Nicolas Nina Noah Noemi Nora Norbert Nuno Olga Oliver Olivia Oscar Otto Pablo Patricia Patrick Paul Paula Pauline Pedro Peter Petra Philip Philipp Pierre Rafael Rainer Ralf Raquel Raul Renate Ricardo Richard Rita Robert Roberto Rosa Ruth Sabine Sam Samuel Sandra Sara Sarah Sebastian Sergio Silvia Simon Sofia Sonia Sophie Stefan Stefanie Stella Susan Susanne Sven Sylvie Tania Teresa Theo Thomas Tiago Tim Tobias Tom Ulrich Ursula Uwe Valentina Vera Veronika Victor Viktor Vincent Walter Werner William Wolfgang Xavier Yann Yara Yves Zoe".split()
ORGANISATION = r"team|office|council|station|press|media|group|club|society|association|institute|museum|library|university|school|company|foundation|editorial|desk|staff|news|agency|board|committee|department|service|ltd|limited|inc|llc|plc|corp|gmbh|ag|kg|ohg|ug|ev|sarl|sas|sa|eurl|sl|slu|ltda|eireli|lda|redaktion|hafenamt|amt|gemeinde|stadt|verlag|verein|bahnhof|rathaus|bibliothek|rédaction|capitainerie|mairie|commune|gare|société|bureau|équipe|association|redacción|oficina|ayuntamiento|equipo|estación|puerto|sociedad|redação|escritório|prefeitura|equipe|estação|porto|sociedade|harbour|harbor|port|town|city|village|festival|market|north|south|east|west|street|road|lane|row|crescent|avenue|square|quarter|bridge|park|river|lake|mount|saint|hall|house|inn|hotel|café|bar"
# Common Chinese family names (fixed values).
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
HAN_ORGANISATION = r"办公室|编辑部|公司|团队|集团|委员会|协会|中心|学校|大学|图书馆|报社|电视台|网|局|部|处|队|店|会"

CAP = r"[A-ZÀ-ÖØ-Þ](?:[a-zà-öø-ÿ’'-]*[a-zà-öø-ÿ])?"
WORD = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{1,}(?:[-’'][A-ZÀ-ÖØ-Þ]?[a-zà-öø-ÿ]+)*"

_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@| ?[\[({] ?(?:at|arroba|ät|chez|bei) ?[\])}] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?(?:dot|punkt|punto|point|ponto) ?[\])}] ?)[A-Za-z0-9-]+)+", re.I
)
_NUMBERS = re.compile(r"(?<![A-Za-z0-9_./,:=&?#-])(?:\(?\d{2} ?\d{6} ?[A-Z] ?\d{3}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![A-Za-z0-9])|(?<![A-Za-z0-9_./,:=&?#-])(?:[A-Z]{1,2} ?)?[+(]?\d(?:[\d]|[ .\-/()]{1,2}(?=[\d(])|[A-Z](?=[0-9A-Z])){3,26}(?:[\dA-Z]|-[A-Z])?(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_ADDRESS = re.compile(
    rf"\b\d{{1,4}}[a-zA-Z]?,? (?:{CAP} ){{1,3}}(?:Street|Road|Lane|Row|Crescent|Avenue|Drive|Close|Court|Terrace|Way|Square|Boulevard|Place|Gardens|Grove|Hill|Mews|Walk|Parade|Quay|St|Rd|Ave|Ln|Dr|Blvd)\b"
    rf"|\b(?:(?:{CAP}-?)*[A-ZÄÖÜ]?[a-zäöüß]+(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|ring|damm|markt|stieg|steig|hof|chaussee|pfad|kamp|graben)|(?:Am|An der|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Alte|Alter|Neue|Lange|Große|Kleine) (?:{WORD})(?: {WORD})?|{WORD}(?:er|er )?(?: Straße| Weg| Platz| Allee| Ring| Ufer| Gasse| Damm| Markt| Chaussee)) \d{{1,4}} ?[a-h]?\b"
    r"|\b\d{1,4}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|quai|impasse|place|allée|chemin|route|cours|passage|square|sentier|ruelle|montée|venelle|faubourg)(?: (?:de|du|des|la|le|les|aux|au|à|en))*(?: [dlDL]['’])? ?[A-ZÀ-Þ][\w’'-]*"
    r"|\b(?:[Cc]alle|C/|[Aa]venida|Avda?\.|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|[Tt]ravesía|[Cc]arrera|[Cc]uesta|[Gg]lorieta|[Pp]asaje|[Cc]allejón|[Rr]ua|R\.|[Tt]ravessa|[Ll]argo|[Pp]raça|[Aa]lameda|[Rr]odovia|[Ee]strada|[Bb]eco|[Ll]adeira|[Cc]alçada|[Vv]iela)(?: (?:de|del|de la|de los|de las|do|da|dos|das|la|el|los|las))*(?: [A-ZÀ-Þ][\w’'-]*){1,3}(?:,? (?:n\.?[ºo°]|nº|núm\.?|número))?,? ?\d{1,4}\b"
    r"|(?:[一-鿿]{1,6}(?:路|街|巷|道|胡同|弄|大街|大道|里))\d{1,5}(?:号|弄)"
)
_CJK_ADDRESS_CUT = re.compile(r"^.*?(?=[一-鿿]{2,3}(?:省|市|区|县|镇|村))")
_NAME = re.compile(
    rf"(?:\b(?P<title>{TITLES})\.? )(?:[A-ZÀ-Þ]\. ?)?(?:(?:de|da|dos|van|von|di|del|la) )?(?P<a>{WORD})|\b(?P<first>{WORD}) (?:(?:{CAP}\.|{WORD}) )?(?:(?:de|da|dos|van|von|di|del|la|zu) )?(?P<last>{WORD})|\b(?P<initial>[A-ZÀ-Þ]\.) ?(?P<b>{WORD})"
)
_NAME_BEFORE = re.compile(r"(?i)(?:\b(?:ask|it was|thanks|thank you|neighbou?r|friend|colleague|by|from|met|with|contact|cheers|regards|asked|danke|nachbar\w*|frag(?: mal)?|von|war(?: es)?|kollege|kollegin|freund\w*|gruß|grüße|merci|demandez à|c[’']est|voisine?|ami|amie|collègue|gracias|pregunta a|fue|vecin[oa]|amig[oa]|compañer[oa]|saludos|obrigad[oa]|pergunta para|foi|vizinh[oa]|colega|abraços))[\s,:]*$")
_NAME_AFTER = re.compile(r"(?i)^[\s,]*(?:who\b|said|says|told|sagt|qui\b|dit\b|quien\b|dijo|quem\b|disse)")
_HAN_NAME = re.compile(rf"(?:(?<=谢谢)|(?<=感谢)|(?<=邻居)|(?<=同事)|(?<=朋友)|(?<=问)|(?<=找)|(?<=叫)|(?<=是)|(?<=联系)|(?<=谢谢，)|(?<=感谢，)|(?<=姓名：)|(?<=我是))([{SURNAMES}][一-鿿]{{1,2}}?)(?=卖给|说|告诉|也|，|。|！|先生|女士|小姐|老师|$|\s|住|讲)|(?:^|[^一-鿿])([{SURNAMES}][一-鿿]{{0,2}}?)(?=先生|女士|小姐|老师)")
_HAN_AUTHOR = re.compile(rf"^([{SURNAMES}][一-鿿]{{1,2}})(?=$|[^一-鿿])")
# A sentence ends before white space, but not in an abbreviation of a number.
_STOP = re.compile(r"[。！？]|(?<!\btel)(?<!\bTel)(?<!\bno)(?<!\bNo)(?<!\bNr)(?<!\bnum)[.!?]\s")
_SPACES = re.compile(r"[ .\-/()]")
_PHONE = re.compile(PHONE_WORDS, re.I)
_ID = re.compile(rf"(?:(?<![a-zà-ÿ])(?:{ID_WORDS})(?![a-zà-ÿ])|身份证|证件|护照|社保|税号)", re.I)
_AGAINST = re.compile(NOT_PERSONAL, re.I)
_ORG = re.compile(rf"(?i)\b(?:{ORGANISATION})\b|s\.l\.|s\.a\.|e\.v\.|& co")
_ORG_AFTER = re.compile(r"(?i)^[ ,]*(?:(?:" + "|".join(w for w in ORGANISATION.split("|")) + r")\b|s\.l\.|s\.a\.|e\.v\.|& co|und söhne)")
_GIVEN = frozenset(GIVEN)


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(number: str) -> bool:
    """ISO 13616: an IBAN whose first four characters move to the end leaves 1."""
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def insee(digits: str) -> bool:
    """French social number: the key is 97 less the rest of the other 13 digits."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def cpf(digits: str) -> bool:
    """Brazilian taxpayer number: two check digits mod 11."""
    if len(digits) != 11 or len(set(digits)) == 1:
        return False
    for n in (9, 10):
        rest = sum(int(d) * (n + 1 - k) for k, d in enumerate(digits[:n])) * 10 % 11 % 10
        if rest != int(digits[n]):
            return False
    return True


def resident_id(number: str) -> bool:
    """Chinese resident number: ISO 7064 mod 11-2."""
    if not re.fullmatch(r"\d{17}[\dX]", number):
        return False
    rest = (12 - sum(int(d) * pow(2, 17 - k, 11) for k, d in enumerate(number[:17]))) % 11
    return number[17] == "0123456789X"[rest]


def nif(number: str) -> bool:
    """Spanish identity number: the letter is chosen by the number mod 23."""
    m = re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", number)
    return bool(m) and len(number) == 9 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(("XYZ".index(m[1]).__str__() if m[1] else "") + m[2]) % 23] == m[3]


def _id_shape(raw: str) -> float:
    """Score of a number as an identity number by its form and checksum alone."""
    bare = _SPACES.sub("", raw)
    digits = re.sub(r"\D", "", bare)
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", bare):
        return 1.5 if mod97(bare) else 0.2
    if re.fullmatch(r"\d{3}([- ])\d{2}\1\d{4}", raw):
        return 1.0
    if re.fullmatch(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", raw):
        return 1.2
    if nif(bare):
        return 1.2
    if re.fullmatch(r"\d{17}[\dX]", bare):
        return 1.5 if resident_id(bare) else 0.6
    if re.fullmatch(r"\d{3}\.\d{3}\.\d{3}-\d{2}", raw):
        return 1.5 if cpf(digits) else 0.9
    if len(digits) == 15 and insee(digits):
        return 1.5
    if len(digits) == 11 and bare == digits and cpf(digits):
        return 0.8
    if 13 <= len(digits) <= 19 and bare == digits and luhn(digits):
        return 0.7
    if re.fullmatch(r"\d{8}[A-Z]\d{3}", bare):
        return 1.0
    if re.fullmatch(r"[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}|[A-Z]\d{8}|\d{2}[A-Z]{2}\d{5}|\d{2}/\d{3}/\d{5}", raw):
        return 0.7
    return 0.3 if len(digits) >= 7 else 0.0


def _phone_shape(raw: str) -> float:
    digits = re.sub(r"\D", "", raw)
    if re.search(r"[A-Z]", raw) or not 6 <= len(digits) <= 15:
        return 0.0
    if raw.startswith("+") and len(digits) >= 9:
        return 1.2
    if re.fullmatch(r"\(\d{2,5}\) ?[\d -]{6,12}", raw):
        return 1.0
    if re.fullmatch(r"1[3-9]\d{9}|1[3-9]\d[ -]\d{4}[ -]\d{4}", raw):
        return 0.9
    if re.fullmatch(r"0\d[\d /.-]{6,13}", raw) and len(digits) >= 9:
        return 0.7
    return 0.6 if re.search(r"[ .\-/]", raw) and len(digits) >= 7 else 0.5 if len(digits) >= 7 else 0.0


def _numbers(text: str, author: bool = False) -> Iterator[Span]:
    for m in _NUMBERS.finditer(text):
        start, raw = m.start(), m.group().rstrip()
        if raw[0] == "(" and ")" not in raw:  # a bracket around the number, not around its prefix
            start, raw = start + 1, raw[1:]
        stop = start + len(raw)
        if re.fullmatch(r"[\d.,]+", raw) and re.match(r"\s?(?:€|元|reais|\$|£|%|km|kg|cm|mm)", text[stop:]):
            continue
        if re.search(r"[$£€R]\s?$", text[:start][-2:]) or re.fullmatch(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}", raw):
            continue
        # Only the words of the same sentence count, before the number the nearest one.
        before = _STOP.split(text[max(0, start - WINDOW) : start])[-1]
        after = re.split(r"[。！？]|[.!?](?:\s|$)", text[stop : stop + WINDOW])[0]
        last = lambda pattern, words=before: max((w.end() for w in pattern.finditer(words)), default=-1)
        id_at, phone_at = last(_ID), last(_PHONE)
        for_id = (id_at >= 0 and id_at >= phone_at) or (phone_at < 0 and bool(_ID.search(after)))
        for_phone = phone_at > id_at or (id_at < 0 and bool(_PHONE.search(after)))
        against = 1.5 if _AGAINST.search(before[-24:]) else 0.0
        shape = _id_shape(raw)
        id_score = shape + 0.9 * for_id - against
        phone_score = _phone_shape(raw) + 0.6 * for_phone - against
        if author and before.endswith("(") and after.startswith(")"):
            id_score += 0.8  # a number in brackets after a name
        elif author and shape < 0.9 and re.search(r"[–—,:|/-]\s*$", before) and not after.strip():
            phone_score += 0.6  # a number that closes an author field after a separator is a way to reach them
        elif shape < 0.7 and not for_id:
            id_score = min(id_score, 0.5)
        kind, score = ("id_number", id_score) if id_score >= phone_score else ("phone", phone_score)
        yield Span(start, stop, kind, score)


def _names(text: str, alone: bool) -> Iterator[Span]:
    """``alone``: the text is an author field, whose whole value may be a name, in capitals throughout as well."""
    if alone and text.isupper() and len(text.title()) == len(text):
        text = text.title()
    at = 0
    while m := _NAME.search(text, at):
        at = m.end()
        words = re.findall(WORD, m.group())
        first, last = m["first"], m["last"]
        if first and first not in _GIVEN:
            # The first word may be a noun or a verb before the name: Nachbar Jonas Velmark, Ask Nora Velmark.
            inner = re.search(rf"\b(?:{'|'.join(sorted(map(re.escape, set(words) & _GIVEN)))}) {WORD}", m.group()) if set(words) & _GIVEN else None
            if inner:
                m2 = _NAME.match(text, m.start() + inner.start())
                if m2:
                    m, at = m2, m2.end()
                    first, last = m["first"], m["last"]
        start, end = m.start(), m.end()
        if first in _GIVEN and len(words) == 3 and words[1] not in _GIVEN and re.fullmatch(rf"{WORD} {WORD} {WORD}", m.group()):
            # Given and family name, then the capital of the next sentence.
            end, last = m.end() - len(words[2]) - 1, words[1]
            at = end
        elif m["title"] and m["a"] in _GIVEN and (more := re.match(rf" {WORD}", text[end:])):
            end += more.end()
            at = end
        name = text[start:end]
        before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
        score = 0.0
        if m["title"]:
            score = 1.2
        elif m["initial"]:
            score = 1.0 if alone else 0.6
        elif first in _GIVEN:
            score = 1.0
        elif not re.search(r"[a-zà-ÿ] $", before) and not alone:
            score = 0.0  # begins a sentence: the capital says nothing
        else:
            score = 0.4
        if _NAME_BEFORE.search(before):
            score += 0.6
        if _NAME_AFTER.search(after):
            score += 0.6
        if alone and start == 0 and re.match(r"\s*(?:$|[,(;/|])", after):
            score += 0.8
        if _ORG.search(name) or _ORG_AFTER.search(after) or re.search(r"[@\w]$", before):
            score = 0.0
        if last in _GIVEN and first not in _GIVEN:
            score = min(score, 0.5)
        yield Span(start, end, "name", score)
        if score < ACCEPT and first:
            at = start + len(first)
    if alone:
        m = re.match(rf"({WORD}), ({WORD})(?=$|\s*[,(;])", text)
        if m and not _ORG.search(m.group()):
            yield Span(m.start(), m.end(), "name", 1.0 + (m[2] in _GIVEN))
        m = _HAN_AUTHOR.match(text)
        if m and not re.search(HAN_ORGANISATION, text.split("，")[0].split(",")[0]):
            yield Span(m.start(1), m.end(1), "name", 1.2)
    for m in _HAN_NAME.finditer(text):
        g = 1 if m[1] else 2
        yield Span(m.start(g), m.end(g), "name", 1.2)


def find(text: str | None, author: bool = False) -> list[Span]:
    """Spans of ``text`` in order, none overlapping. Null and empty texts have none."""
    if not text:
        return []
    found = [Span(m.start(), m.end(), "email", 2.0) for m in _EMAIL.finditer(text)] if "@" in text or re.search(r"[\[({] ?(?:at|arroba|ät|chez|bei)\b", text, re.I) else []
    if any(c.isdigit() for c in text):
        found += [s for s in _numbers(text, author) if s.score >= ACCEPT]
        for m in _ADDRESS.finditer(text):
            cut = _CJK_ADDRESS_CUT.match(m.group())
            found.append(Span(m.start() + (cut.end() if cut else 0), m.end(), "address", 1.8))
    found += [s for s in _names(text, author) if s.score >= ACCEPT]
    kept: list[Span] = []
    for s in sorted(found, key=lambda s: (-s.score, s.start)):
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def redact(text: str | None, author: bool = False) -> str | None:
    """``text`` with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]`` in place of its spans."""
    if not text:
        return text
    parts, at = [], 0
    for s in find(text, author):
        parts += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*parts, text[at:]])


def places(content: DataFrame) -> DataFrame:
    """``content_id, place, text``: the authors and the texts of all comments, each once."""
    rows = content.where("content_id is not null")
    authors = rows.where("author is not null and author <> ''").select("content_id", F.lit("author").alias("place"), F.col("author").alias("text"))
    comments = comments_of(rows).where("text is not null and text <> ''").select("content_id", F.col("comment_id").alias("place"), "text")
    return authors.unionByName(comments)


def found(content: DataFrame) -> DataFrame:
    """``content_id, place, kind``: each kind of personal information in a place once.

    Null and empty authors and comments, and comments that aren't valid JSON, give none; records that arrived twice
    count once; extra columns are ignored.
    """

    @F.pandas_udf("array<string>")
    def kinds(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, place in batches:
            yield pd.Series([sorted({s.kind for s in find(t, p == "author")}) for t, p in zip(texts, place)])

    return places(content).select("content_id", "place", F.explode(kinds("text", "place")).alias("kind")).distinct()


def redacted(content: DataFrame) -> DataFrame:
    """``content_id, place, text``: the text of each place with typed placeholders."""

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, place in batches:
            yield pd.Series([redact(t, p == "author") for t, p in zip(texts, place)], dtype=object)

    return places(content).select("content_id", "place", cleaned("text", "place").alias("text")).distinct()
