"""Template residue, filler and server messages where content belongs (problem 2).

Unfilled placeholders are found by one grammar per delimiter, outside code blocks and inline code. A sentence that
talks about templates, and a page that is dense with placeholders because it teaches them, is discounted. Filler is
found by its set phrases and by the density of the pseudo-Latin vocabulary in a sentence. A page is a server
message if it is short and each of its sentences is one, or one that goes with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.session import spread

NAME = r"[A-Za-zÀ-ÿ_][\wÀ-ÿ.\- ]{0,40}?"
# The grammar of each kind of placeholder.
DELIMITED = {
    "mustache": rf"\{{\{{\{{?\s*[#/^>&!]?{NAME}(?:\s*\|[^{{}}\n]{{0,40}})?\s*\}}?\}}\}}",
    "tag": r"\{%-?\s*[a-z]+\b[^{}%\n]{0,80}%\}",
    "dollar": rf"[$#]\{{\s*{NAME}\s*\}}",
    "angle": rf"<%[=-]?\s*{NAME}\s*-?%>|<\?(?:php|=)[^<>\n]{{0,80}}\?>|<<\s*{NAME}\s*>>",
    "percent": r"(?<![\w%])%[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9]*(?:_[A-Za-zÀ-ÿ0-9]+)*%(?![\w%])|%\([A-Za-z_]\w*\)[sdrifSDRIF]\b",
    "at": rf"@@\s*{NAME}\s*@@",
    "underscore": r"(?<!\w)__[A-ZÀ-Þ][A-ZÀ-Þ0-9]*(?:_[A-ZÀ-Þ0-9]+)*__(?!\w)",
    "brace": r"(?<![\w{$#\\])\{[A-Za-zÀ-ÿ][\wÀ-ÿ]{1,40}(?:\.[\wÀ-ÿ]+)*\}(?!\})",
    "square": rf"\[\[\s*{NAME}\s*\]\](?!\()|\[[A-ZÀ-Þ]{{3,}}(?:[_ ][A-ZÀ-Þ0-9]+)*\](?![(:\[])",
}
# What a program prints for a value that is not there.
UNSET = r"\[object Object\]|\[OBJECT OBJECT\]|(?<![\w.\-])(?:undefined|UNDEFINED|NaN|NAN)(?![\w\-])"
PLACEHOLDER = re.compile("|".join([*DELIMITED.values(), UNSET]))
PRINTF = re.compile(r"(?<![\w%])%[-+0 ]?\d*(?:\.\d+)?[sdifuxSDIFUX](?!\w)")

# Whole sentences that stand in for content still to be written.
FILLER = re.compile(
    r"""(?:^|(?<=[.!?:;]\s)|(?<=["'“«>*_-]\s)|(?<=["'“«>*_-]))(?:
    (?:your|the|some|insert|add|enter|put|write|type)\s(?:own\s|your\s|the\s|some\s|a\s)*(?:text|copy|content|message|title|headline|description|name|caption|heading|body|tagline|bio)\s(?:goes\s)?here
    |(?:message|text|content|title|description)\sgoes\shere
    |placeholder\s(?:copy|text|content|image|title)\b[^.\n]{0,60}
    |this\sis\s(?:a|an|some|just)\s(?:sample|dummy|placeholder|example|filler|test)\s(?:paragraph|text|page|post|content|sentence)\b[^.\n]{0,80}
    |(?:describe|summari[sz]e)\s(?:the|your)\s\w+\sin\s\w+\sor\s\w+\s(?:sentences|words|lines)
    |(?:add|write|insert)\sa\sshort\s\w+\s(?:for|about|of)\sth(?:is|e)\s\w+
    |(?:todo|tbd|fixme|tk)\s?:\s?(?:write|add|insert|fill|text|copy|message|content|translate)\b[^.\n]{0,60}
    |(?:text|copy|content)\s(?:to\sbe\s(?:supplied|written|added|provided)|to\scome|to\sfollow)\b[^.\n]{0,50}
    |(?:aquí|aqui)\s(?:va|irá|iría|viene)\s(?:su|tu|el|la)\s\w+ | (?:su|tu)\s(?:texto|contenido|mensaje|título)\s(?:aquí|va\saquí)
    |(?:texto|contenido|imagen|título)\s(?:provisional|de\srelleno|de\smuestra|de\sejemplo|de\sprueba)\b[^.\n]{0,60}
    |(?:párrafo|texto)\sde\s(?:muestra|ejemplo|relleno|prueba)\b[^.\n]{0,70}
    |(?:describa|describe|resuma|resume)\s(?:el|la|su|tu)\s\w+\sen\s\w+\so\s\w+\s(?:frases|palabras|líneas)
    |(?:añada|agregue|escriba|añade|escribe|inserte|ponga)\s(?:un|una|aquí|su|tu)\s[^.\n]{3,60}\b(?:imagen|foto|fotografía|aquí|página|sección|texto|figura)
    |votre\s(?:texte|contenu|message|titre)\s(?:va\s)?ici | (?:insérez|placez|écrivez|saisissez|mettez)\s(?:ici\s)?(?:votre|un|une|le)\s(?:texte|contenu|message|titre)\b[^.\n]{0,50}
    |(?:texte|contenu|image|titre)\s(?:provisoire|de\sremplissage|factice|d['’]exemple)\b[^.\n]{0,70}
    |paragraphe\sd['’]exemple\b[^.\n]{0,70}
    |(?:décrivez|résumez)\s(?:le|la|votre|l['’])\s?\w+\sen\s\w+\sou\s\w+\s(?:phrases|mots|lignes)
    |ajoutez\s(?:une|un)\s[^.\n]{3,50}\b(?:image|photo|figure|page|section|légende)
    |hier\s(?:steht|kommt|folgt)\s(?:ihr|dein|der|euer)\s(?:eigener\s)?(?:text|inhalt|titel|beitrag) | (?:ihr|dein)\s(?:text|inhalt|titel)\s(?:hier|kommt\shier(?:her|hin)?|steht\shier)
    |(?:platzhalter|platzhaltertext|blindtext|beispieltext|mustertext|fülltext|beispielabsatz|musterabsatz)\b\s?[,;:(-][^.\n]{0,70} | (?:platzhalter|platzhaltertext|blindtext|beispieltext|mustertext|fülltext|beispielabsatz|musterabsatz)\b(?=\s*[.!]?\s*$)
    |(?:vorläufiger|provisorischer)\s(?:text|inhalt)\b[^.\n]{0,60}
    |(?:dies|das)\sist\sein\s(?:beispiel|muster|platzhalter|probe)\w*\b[^.\n]{0,70}
    |(?:beschreiben|beschreibe|fassen)\s(?:sie\s)?(?:den|die|das|ihren?|ihr)\s\w+\s(?:\w+\s)?in\s\w+\s(?:oder|bis)\s\w+\s(?:sätzen|worten|zeilen)\b[^.\n]{0,20}
    |(?:fügen|schreiben|ergänzen|setzen)\ssie\s(?:hier\s)?(?:eine?n?|ihren?)\s[^.\n]{3,60}\b(?:bild|foto|ein|hinzu|unterschrift|abbildung)
    )\s?["'”»*_]*\s*(?:[.!;…)]|$)""",
    re.I | re.X | re.M,
)
# The vocabulary of pseudo-Latin filler.
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
    enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit
    voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt
    mollit anim id est laborum vivamus mattis ornare pretium turpis egestas pellentesque habitant morbi tristique senectus netus malesuada
    fames ac vestibulum tortor quam feugiat vitae ultricies eget tempus donec mauris placerat eleifend leo praesent dapibus neque cursus
    faucibus nunc felis porta sagittis augue rhoncus lectus nam varius erat semper risus aliquam blandit""".split()
)
LATIN_HINT = re.compile(r"\b(?:lorem|ipsum|consectetur|adipiscing|adipisicing|eiusmod|incididunt|nostrud|ullamco|laboris|aliquip|reprehenderit|cillum|excepteur|occaecat|cupidatat|proident|deserunt|vivamus|pellentesque|vestibulum)\b", re.I)
#: Words and share of pseudo-Latin that make a sentence filler.
LATIN_WORDS, LATIN_SHARE = 4, 0.6

# Words of one who writes about templates, in a sentence with a placeholder.
ABOUT = re.compile(r"\b(?:templates?|templating|placeholders?|syntax|delimiters?|renderer|escap\w+|literally|variable|plantillas?|marcador(?:es)?|sintaxis|literalmente|vorlagen?|platzhalter|syntaxe|gabarits?|modèles?|littéralement|balises?)\b", re.I)
FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
INLINE = re.compile(r"(`+)[^`\n]+?\1|<(code|pre|kbd)\b[^>]*>.*?</\2>", re.S | re.I)
SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?](?!\s|$)[^.!?\n]*)*[.!?]*")
WORDS = re.compile(r"[^\W\d_]+")
#: A page of that many code samples or more, which also has placeholders in its text, teaches them.
TUTORIAL_CODE = 4

# What servers say instead of a page.
STATUS = (
    r"(?:https?\s|http/\d\S*\s)?(?:error|fehler|erreur|status|código|code)?[\s:#-]{0,3}[45]\d\d(?:[\s:–—-]{1,3}(?:bad gateway|bad request|internal server error|not found|page not found|forbidden|unauthorized|service unavailable|"
    r"service temporarily unavailable|gateway time-?out|too many requests|gone|payment required|method not allowed|request timeout|not acceptable|origin unreachable))?|"
    r"(?:bad gateway|bad request|internal server error|page not found|not found|forbidden|service unavailable|gateway time-?out|too many requests)"
)
CORE = (
    r"page (?:you (?:were|are) looking for|requested|you requested)\b|(?:page|file|resource|url)\b[^.]{0,30}\b(?:could not be|was not|cannot be|can't be) found\b|(?:may|might) have (?:been )?moved or|no longer (?:exists|available)|(?:was|been) removed by its owner|nothing here yet",
    r"no (?:encontramos|se (?:encuentra|encontró|ha encontrado)|existe) (?:la|esta|esa) página|la página\b.{0,200}\bno (?:existe|se encuentra)|puede que haya cambiado de sitio|el contenido\b.{0,60}\bya no (?:existe|está disponible)|página no encontrada",
    r"page (?:demandée|recherchée)?\s?(?:est )?introuvable|la page\b.{0,200}\b(?:n'existe (?:pas|plus)|est introuvable)|(?:le contenu|cet article|l'article)\b.{0,60}\b(?:n'existe plus|a été (?:supprimé|retiré))|page non trouvée",
    r"(?:gewünschte|angeforderte|gesuchte) seite\b|seite\b.{0,200}\bnicht gefunden|(?:inhalt|beitrag|artikel|seite)\b.{0,60}\b(?:gibt es nicht mehr|existiert nicht|wurde (?:entfernt|gelöscht))",
    r"something went wrong|(?:an|internal|unexpected) (?:server )?error (?:has )?occurred|error establishing a database|fatal error:|uncaught exception|template not loaded|internal server error|the upstream did not answer|upstream (?:server|request)\b.{0,30}(?:error|timeout|failed)",
    r"algo ha (?:fallado|ido mal)|algo salió mal|se ha producido un error|ha ocurrido un error|error interno del servidor|servicio (?:temporalmente )?no disponible|el servidor no (?:responde|respondió)",
    r"une erreur\b.{0,30}(?:survenue|produite)|erreur interne du serveur|service (?:temporairement )?indisponible|le serveur (?:ne répond pas|n'a pas répondu)|quelque chose s'est mal passé",
    r"ist ein fehler aufgetreten|fehler ist aufgetreten|interner serverfehler|dienst\b.{0,20}nicht (?:verfügbar|erreichbar)|etwas ist schiefgelaufen|server antwortet nicht",
    r"access (?:is |was )?denied|do not have permission (?:to|for)|don't have permission|you are not (?:allowed|authorized)|acceso denegado|no tiene permiso para|accès (?:refusé|interdit)|pas le droit de|n'êtes pas autorisé|zugriff (?:verweigert|nicht erlaubt)|dürfen\b.{0,60}\bnicht (?:öffnen|ansehen|aufrufen)|keine berechtigung",
    r"down for (?:scheduled )?maintenance|(?:will be|we'll be|be) back (?:shortly|soon)|undergoing maintenance|estamos en mantenimiento|(?:sitio|página) en mantenimiento|volverá pronto|site en maintenance|en cours de maintenance|revient bientôt|de retour bientôt|wartungsarbeiten|wird gerade gewartet|bald wieder (?:da|zurück|verfügbar)",
    r"just a moment|verify(?:ing)? (?:that )?you are (?:a )?human|checking your browser|are you a robot|you are not a robot|prove you are human|un momento\b.{0,40}(?:comprob|verific)|(?:comprobando|comprobamos|verificando|verificamos|compruebe|confirme) (?:que|si) (?:usted |no )?es|un instant\b.{0,40}vérifi|vous n'êtes pas un robot|vous êtes (?:bien )?humain|(?:einen|ein) moment\b.{0,40}(?:prüf|überprüf)|ob sie ein mensch sind|kein roboter",
    r"(?:enable|turn on|switch on|activate|allow) (?:javascript|scripts)\b|(?:javascript|scripts) (?:is |are )?(?:disabled|turned off|switched off|switched on|required|needed)|with (?:javascript|scripts) (?:switched|turned) on|requires? javascript",
    r"activ[ea]r? javascript|scripts desactivados|(?:permita|habilite|active) (?:los )?scripts|javascript (?:está )?desactivado|activer (?:javascript|les scripts)|autoris(?:er|ez) (?:javascript|les scripts)|activez (?:javascript|les scripts)|(?:scripts|javascript) (?:sont |est )?désactivés?|a besoin de (?:scripts|javascript)|(?:blocks?|bloquea|bloque|blockiert) (?:los |les )?(?:scripts|javascript|skripte)|"
    r"javascript (?:bitte )?(?:einschalten|aktivieren|zulassen|erlauben)|skripte (?:bitte )?(?:einschalten|aktivieren|zulassen|erlauben)|braucht (?:skripte|javascript)|skripte\b.{0,30}(?:erlauben|zulassen|ausgeschaltet|deaktiviert)",
    r"session has (?:expired|timed out)|sign in again|sesión ha (?:caducado|expirado)|vuelva a identificarse|session (?:a )?expiré|reconnectez-vous|sitzung (?:ist )?abgelaufen|erneut anmelden|melden sie sich (?:erneut|neu|wieder) an",
    r"too many requests|slow down and retry|demasiadas (?:peticiones|solicitudes)|trop de requêtes|zu viele anfragen",
)
# Sentences that go with such a message.
BESIDE = (
    r"(?:incident|incidencia|vorfall)\b.{0,50}(?:logged|registrad[ao]|enregistré|notiert|gemeldet|erfasst)?|your request took|su petición tardó|votre requête a|ihre anfrage dauerte|(?:ray|ref|reference|referencia|référence|referenz|code|código|kennung|id)\b[.:]?(?:\s?[#\da-f-]+|\s*$)",
    r"(?:check|verify) the (?:address|url|spelling)|(?:return|go back|back) to the (?:start|home|front)|use the search|write to the webmaster|contact (?:the|your) (?:administrator|webmaster|site owner|support)|(?:sorry|apologi[sz]e) for|we are sorry|thank you for your patience|please (?:try|wait|check|retry|reload|refresh)|try again|if (?:this|the problem|nothing)\b.{0,40}|loading\.*|go back",
    r"(?:compruebe|revise|verifique) (?:que )?la dirección|vuelva (?:a la|al)|volver (?:a la|al)|pruebe con|disculpe las|lo sentimos|perdone|avise al|si (?:el problema|no ocurre)|inténtelo|gracias por su paciencia|cargando\.*|¡?vaya!?|uy|ups",
    r"vérifiez l'adresse|retour(?:nez)? à l'accueil|revenez à|utilisez la recherche|essayez (?:la|le|avec)|(?:veuillez|merci de) (?:nous excuser|patienter|réessayer)|nous excuser|désolé|si (?:le problème|rien)|prévenez|réessayez|merci de votre patience|chargement\.*|oups",
    r"(?:bitte )?(?:die adresse|prüfen sie)\b.{0,40}|(?:zurück )?zur startseite|nutzen sie die suche|(?:wir )?bitten um (?:entschuldigung|geduld)|entschuldig\w+|bleibt der fehler|schreiben sie dem|versuchen sie|danke für ihre geduld|wird geladen|laden\.*|leider|hoppla|suche (?:nutzen|verwenden)",
    r"un momento|espere|un instant|patientez|einen moment|moment bitte|one moment|please wait|oops|error|whoops|\(?[\da-f]{3,16}\)?",
)
MESSAGE = re.compile("|".join(CORE), re.I)
WHOLE_STATUS = re.compile(STATUS, re.I)
ALONG = re.compile(r"[\W_]*(?:" + "|".join(BESIDE) + ")", re.I)
HTML = re.compile(r"<(?:!doctype|html|head|body|title|center|div|h[1-6]|p|script|meta)\b", re.I)
FETCH = re.compile(r"(?:https?|http/\d\S*)\s\d{3}\b(?:\W*\w+){0,5}\W*$", re.I)
#: Words of the longest sentence of a server message.
MESSAGE_WORDS = 45
UNIT = re.compile(r"(?<=[.!?…])\s+|\n+")


def is_message(text: str) -> bool:
    """Whether the page is nothing but a message of a server."""
    stripped = text.strip()
    if not stripped:
        return False
    found = False
    lines = [line.strip() for line in stripped.split("\n") if line.strip()]
    for at, line in enumerate(lines):
        heading = line.startswith("#")
        own = re.sub(r"<[^<>]+>", " ", line.lstrip("#> *_-").rstrip("*_ ").replace("’", "'"))
        for unit in UNIT.split(own):
            unit = unit.strip()
            if not unit:
                continue
            bare = unit.strip(" .!…#*_()")
            status = WHOLE_STATUS.match(bare)
            if status and (status.end() == len(bare) or ALONG.match(bare[status.end() :])) or (len(unit.split()) <= MESSAGE_WORDS and MESSAGE.search(unit)):
                found = True
            elif not (ALONG.match(unit) or not bare or (heading and at == 0)):
                return False
    return found


def page_text(text: str) -> str:
    """The text without code blocks and inline code."""
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n", text)
    if "`" in text or "<" in text:
        text = INLINE.sub(" ", text)
    return text


def _sentence(text: str, start: int, end: int) -> str:
    left = max(text.rfind(c, 0, start) for c in ".!?\n")
    right = min((p for p in (text.find(c, end) for c in ".!?\n") if p >= 0), default=len(text))
    return text[left + 1 : right]


def unfilled(text: str) -> bool:
    """Whether page text holds a placeholder or unset value that is not written about."""
    found = None
    for found in PLACEHOLDER.finditer(text):
        sentence = _sentence(text, found.start(), found.end())
        quoted = text[found.start() - 1 : found.start()] in ('"', "'", "“", "«", "‘") and text[found.end() : found.end() + 1] in ('"', "'", "”", "»", "’")
        if not (quoted or ABOUT.search(PLACEHOLDER.sub(" ", sentence))):
            return True
    return False


def filler(text: str) -> bool:
    """Whether page text holds filler: a set phrase as a sentence, or a sentence mostly of pseudo-Latin."""
    if FILLER.search(text):
        return True
    hint = LATIN_HINT.search(text)
    while hint:
        sentence = _sentence(text, hint.start(), hint.end())
        words = [w.lower() for w in WORDS.findall(sentence)]
        latin = sum(w in LATIN for w in words)
        if latin >= LATIN_WORDS and latin >= LATIN_SHARE * len(words):
            return True
        hint = LATIN_HINT.search(text, hint.end())
    return False


def residue_of_page(text: str | None) -> str | None:
    """Why a page's content is residue: ``message``, ``placeholder`` or ``filler``; None if it is not."""
    if not text or not text.strip():
        return None
    if is_message(text):
        return "message"
    own = page_text(text)
    # A page full of code samples that shows placeholders between them is a tutorial, unless they are many more.
    samples = (len(text) - len(own) > 0) and text.count("```") // 2
    if unfilled(own) and not (samples and samples >= TUTORIAL_CODE and len(PLACEHOLDER.findall(own)) <= samples):
        return "placeholder"
    return "filler" if filler(own) else None


def residue_of_error(text: str | None) -> str | None:
    """Why a stored error is residue: ``placeholder``, ``filler`` or ``page``; None if it tells of the fetch."""
    if not text or not text.strip():
        return None
    own = text.strip()
    if PLACEHOLDER.search(own) or PRINTF.search(own):
        return "placeholder"
    if filler(own) or (LATIN_HINT.match(own) and all(w.lower() in LATIN for w in WORDS.findall(own))):
        return "filler"
    if HTML.search(own):
        return "page"
    # A status alone is what the fetch met; the words of a page are what it brought instead.
    return "page" if MESSAGE.search(own) and not WHOLE_STATUS.fullmatch(own) and not FETCH.match(own) else None


def residue(df: DataFrame, key: str, column: str, judge=residue_of_page) -> DataFrame:
    """(``key``, ``reason``) of the rows of ``df`` whose text in ``column`` is residue, by ``judge``.

    Null, empty and blank texts are no residue. Repeated rows are judged alike; a row gives one reason.
    """
    texts = spread(df.select(F.col(f"`{key}`").alias(key), F.col(f"`{column}`").alias("text")).filter("text IS NOT NULL"))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = [judge(text) for text in batch.column(1).to_pylist()]
            rows = [i for i, reason in enumerate(reasons) if reason]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([reasons[i] for i in rows], pa.string())], [key, "reason"])

    return texts.mapInArrow(run, f"`{key}` {kind}, reason string")
