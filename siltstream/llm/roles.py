"""What a short line of a web page does there, told by its wording in English, Spanish, French and German.

The patterns describe whole lines. A sentence about cookies or menus inside a paragraph is longer than its
pattern and keeps the role of its paragraph.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Longer lines are paragraphs.
LONGEST = 260

# The labels of site menus.
MENU = set(
    """home|news|events|opinion|opinions|gallery|services|log in|login|sign in|register|maps|jobs|help|contact|contact us|archive|archives|
    weather|about us|about|search|shop|blog|faq|sitemap|site map|subscribe|newsletter|account|my account|
    inicio|noticias|agenda|eventos|opinión|galería|servicios|entrar|mapas|empleo|ayuda|contacto|archivo|el tiempo|quiénes somos|buscar|tienda|
    accueil|actualités|événements|galerie|connexion|cartes|emploi|aide|météo|qui sommes-nous|rechercher|boutique|à propos|
    startseite|nachrichten|termine|meinung|dienste|anmelden|karten|stellen|hilfe|kontakt|archiv|wetter|impressum|suche|über uns|datenschutz""".replace("\n", "").replace("    ", "").split("|")
)
# The labels of consent buttons.
BUTTONS = """accept all|accept|decline|reject all|reject|refuse|manage choices|manage|customise|customize|settings|ok, i understand|i understand|
got it|ok|agree|allow all|more options|
aceptar todo|aceptar|rechazar todo|rechazar|más opciones|personalizar|configurar|de acuerdo|entendido|
tout accepter|accepter|tout refuser|refuser|options|paramétrer|personnaliser|réglages|j'ai compris|d'accord|
alle annehmen|annehmen|alle ablehnen|ablehnen|mehr|optionen|einstellungen|anpassen|verstanden|einverstanden|zustimmen""".replace("\n", "").split("|")  # fmt: skip
# Names of languages in language switches.
LANGUAGES = set("english|español|espanol|français|francais|deutsch|català|italiano|português|nederlands|polski|galego|euskara|en|es|fr|de|ca|it|pt".split("|"))

SITE = r"[^.,;:!?]{1,60}"
MAIL = r"\S+@\S+"
# Whole lines of page furniture by what they do. SITE stands for a name.
LINES: dict[str, tuple[str, ...]] = {
    "skip": (
        r"(skip|jump) to (the )?(main )?(content|navigation|article)", r"(saltar|ir) al contenido( principal)?",
        r"(aller|passer) au contenu( principal)?", r"(zum|direkt zum) (haupt)?inhalt( springen)?",
    ),
    "search": (
        r"search( in)? (this|the|our) (web)?site", r"buscar en (el|este) sitio", r"(re)?chercher (sur|dans) (le|ce) site",
        r"(diese )?(web)?seite durchsuchen", r"suche auf der seite",
    ),
    "crumbs": (
        r"(you are here|está aquí|estás aquí|usted está aquí|está en|estás en|vous êtes ici|sie sind hier|du bist hier) ?: ?.*",
        r"(home|inicio|accueil|startseite) ?[>/›»] ?.*", r"[^>»›.!?]{2,40}( [»›] [^»›]{2,120})+", r"[^>/.!?]{2,30}( > [^>]{2,120})+",
    ),
    "consent": (
        r"(we|this (web)?site|this page|our site)( and our partners)? (uses?|stores?|sets?)( \S+){0,3} (cookies|files)\b.*",
        r"by (browsing|using|continuing|visiting)\b.{0,90}\bcookies", r"your privacy matters\b.*", r"we (value|respect|care about) your privacy.*",
        r"(usamos|utilizamos|este sitio usa|este sitio utiliza) cookies\b.*", r"este sitio guarda pequeños archivos\b.*",
        r"si (sigue|continúa|sigues) naveg\w+\b.*cookies", r"(su|tu) privacidad (nos )?importa\b.*",
        r"(nous utilisons|ce site utilise) des cookies\b.*", r"ce site (enregistre|dépose|garde|conserve) de petits fichiers\b.*",
        r"en (poursuivant|continuant|naviguant)\b.*cookies", r"votre vie privée (nous )?(compte|importe)\b.*",
        r"(wir verwenden|wir nutzen|diese (web)?seite (verwendet|nutzt)) cookies\b.*", r"diese (web)?seite (speichert|legt) kleine dateien\b.*",
        r"mit der (weiteren )?nutzung\b.*cookies( zu)?", r"(ihre|deine) privatsphäre (zählt|ist uns wichtig)\b.*",
    ),
    "others": (
        r"read next", r"(related|similar|recommended|latest|more) (articles|stories|posts|pages|reading)", rf"trending (on|at|in) {SITE}", r"trending( now)?",
        r"popular (this week|today|now|right now|articles|stories)", r"(you may|you might) also like", rf"more (from|on) {SITE}", r"most (read|viewed|popular|shared)", r"see also|read also",
        r"artículos relacionados", r"(lo más )?popular esta semana", r"también (te|le) puede interesar", rf"más de {SITE}", r"sigue leyendo", r"(lo|los) más (leído|leídos|visto)",
        rf"tendencias en {SITE}", r"te puede interesar", r"lee también|ver también",
        r"articles (liés|similaires|associés)", r"populaires? cette semaine", r"(cela|ceci|vous) (pourrait|pourraient|aimerez|devriez|peut)\b.{0,40}", r"à (lire|voir) aussi", rf"plus de {SITE}",
        r"les plus (lus|vus|partagés)", rf"tendances (sur|de|chez|à) {SITE}", r"à lire ensuite|lire la suite|poursuivre la lecture|pour continuer|lisez aussi",
        r"(ähnliche|verwandte|weitere) (beiträge|artikel)", r"beliebt (diese|in dieser) woche", r"das könnte (sie|dich) auch interessieren", rf"mehr (von|aus) {SITE}", r"meistgelesen|am meisten gelesen",
        rf"(im )?(trend|trends) (auf|bei|in) {SITE}", rf"{SITE} im trend", rf"gerade beliebt( auf| bei)? {SITE}", r"(jetzt |hier )?(weiterlesen|als nächstes lesen|lesen sie (auch|weiter)|auch interessant|mehr zum thema)", r"siehe auch",
    ),
    "ad": (
        r"advertisements?|advertising|sponsored( content)?|ad", r"publicidad|anuncio|contenido patrocinado", r"publicité|annonce|contenu sponsorisé", r"anzeige|werbung|gesponsert",
        r"((partner|special|our) )?offer ?: ?.*", r"oferta(s)? (de|del|para) (socio|socios|colaborador|colaboradores|un socio|nuestros socios|amigos) ?: ?.*", r"oferta( \w+)? ?: ?.*",
        r"offre( (partenaire|spéciale|de nos partenaires|du partenaire|d'un partenaire))? ?: ?.*", r"(partnerangebot|angebot( (des|unseres|unserer) partners?)?) ?: ?.*",
    ),
    "letter": (
        r"(sign up|subscribe|register) (for|to) (the |our )?.{1,60}\b(newsletter|letter|mailing list)", r"get our (weekly |daily |monthly )?(letter|newsletter)\b.*",
        r"(never|don't) miss (a|any) (story|thing|post)\b.*", r"(suscríbete|suscríbase|apúntate) (al|a nuestro|a la) (boletín|carta|lista)\b.*", r"recibe cada \w+ (la|el) (carta|boletín)\b.*",
        rf"no te pierdas nada ?: ?.*", r"(abonnez|inscrivez)-vous (à|a) (la|notre) (lettre|newsletter|liste)\b.*", r"recevez .{1,60} chaque \w+", r"ne (manquez|ratez) (rien|aucun\w* \w+|plus rien) ?: ?.*",
        r"(den|unseren) (rundbrief|newsletter)\b.*\b(bestellen|abonnieren|anmelden)", r"jeden \w+ (post|einen brief|den brief) von\b.*", r"(nichts|keine geschichte|keinen beitrag)( mehr)? verpassen ?: ?.*", rf"(verpassen sie|verpasse) nichts ?: ?.*",
    ),
    "share": (
        r"share (on|this|via|it|with)\b.{0,80}", r"send this (page|article|story) to\b.{0,60}", r"(did you like|liked|enjoyed) (it|this)\b.{0,10}\? ?(share|pass|tell)\b.*",
        r"(comparte|compartir|compártelo)( en| este| esta| con)\b.{0,80}", r"envía (esta|este) \w+ a\b.{0,60}", r"¿?te ha gustado\? ?(compártelo|comparte)\b.*",
        r"partage[rz] (cet|cette|sur|avec|ce)\b.{0,80}", r"envoyez (cette|cet) \w+ à\b.{0,60}", r"cela vous a plu ?\? ?partagez.*",
        r"(diesen|diese|dieses) (beitrag|seite|artikel|text)\b.{0,70}\bteilen", r"(diese |die )?seite an\b.{0,40}\bsenden", r"gefallen\? ?(weitergeben|teilen|weitersagen).*", r"(im|in|auf) .{1,40} teilen", r"teilen (im|in|auf|sie)\b.{0,40}",
    ),
    "tags": (r"(tags?|labels|topics|keywords|filed under|etiquetas|temas|mots-clés|mots clés|étiquettes|thèmes|schlagwörter|schlagworte|stichwörter|stichworte|themen) ?: ?.*",),
    "counter": (
        r"[\d.,]+ (views?|visits?|reads?), [\d.,]+ (likes?|votes?|shares?|comments?)", r"visitors today ?: ?[\d.,]+.*", r"comments? \([\d.,]+\)", r"(page )?served in [\d.,]+ m?s",
        r"(weather|el tiempo|tiempo|météo|wetter) (in|en|à|a|de) .{1,40}: ?-?[\d.,]+ ?(hpa|°c|°|mm|mbar)",
        r"[\d.,]+ (visitas|lecturas), [\d.,]+ (me gusta|votos)", r"(visitantes|visitas) (de )?hoy ?: ?[\d.,]+.*", r"comentarios \([\d.,]+\)", r"página servida en [\d.,]+ m?s",
        r"[\d.,]+ (vues|visites|lectures), [\d.,]+ (mentions|j'aime|votes)\b.*", r"(visiteurs|visites) (du jour|aujourd'hui) ?: ?[\d.,]+.*", r"commentaires \([\d.,]+\)", r"page servie en [\d.,]+ m?s",
        r"[\d.,]+ (aufrufe|leser|besuche), [\d.,]+ (stimmen|likes|gefällt mir)", r"(besucher|besuche) heute ?: ?[\d.,]+.*", r"kommentare \([\d.,]+\)", r"seite (erzeugt|geladen|erstellt) in [\d.,]+ m?s",
    ),
    "paging": (r"«.*»", r"(article|artículo|beitrag|artikel|page|página|seite|post) [\d.,]+ (of|de|sur|von|/) [\d.,]+"),
    "login": (
        r"(log in|sign in|register) to (leave a |post a )?(comment|reply)", r"(inicia|inicie) sesión para (comentar|responder)", r"connectez-vous pour (commenter|répondre)",
        r"(zum kommentieren (bitte )?anmelden|anmelden, um zu kommentieren|melden sie sich an, um zu kommentieren)", r"leave a comment|deja un comentario|laisser un commentaire|kommentar schreiben",
    ),
    "legal": (
        r"©.*", r"(copyright|\(c\)) .{0,80}", r"all rights reserved", r"(todos los derechos reservados|tous droits réservés|alle rechte vorbehalten)",
        r"(terms( of use| of service)?|privacy( policy)?|imprint|legal( notice)?|accessibility|aviso legal|privacidad|accesibilidad|mentions légales|confidentialité|accessibilité|nutzung(sbedingungen)?|datenschutz|impressum|barrierefreiheit)",
        r"site ?map|mapa del sitio|plan du site|seitenplan|sitemap|seitenübersicht", r"back to (the )?top|volver arriba|haut de page|retour en haut|nach oben|zum seitenanfang",
        rf"(contact the (desk|editors|newsroom)|write to us|escríbenos|escríbanos|nous écrire|écrivez-nous|post an|schreiben sie uns|kontakt) ?: ?{MAIL}",
        rf"(powered|made|built) (by|with) {SITE}", rf"(hecho|creado) con (páginas )?{SITE}", rf"(propulsé|réalisé|fait|créé) (par|avec) (les pages )?{SITE}", rf"(erstellt|gemacht|gebaut|betrieben) (mit|von) {SITE}", rf"{SITE} pages|pages {SITE}",
        rf"{SITE} is published by the {SITE}", rf"{SITE} es una publicación de {SITE}", rf"{SITE} est (édité|publié) par {SITE}", rf"{SITE} wird von (der|dem) {SITE} herausgegeben",
        rf"figures are provisional and may be revised by {SITE} without notice", rf"los datos son provisionales y {SITE} puede revisarlos sin aviso",
        r"(les )?(chiffres|données)\b.{0,30}provisoires\b.{0,90}", r"(die |alle )?(zahlen|angaben|daten)\b.{0,20}vorläufig\b.{0,90}",
        rf"{SITE} (accepts no|assumes no|disclaims all) liability\b.{{0,60}}", rf"{SITE} no (responde|se responsabiliza) de (los )?errores\b.{{0,40}}", rf"{SITE} décline toute responsabilité\b.{{0,60}}", rf"{SITE} haftet nicht für\b.{{0,40}}",
        rf"the views expressed (here )?are those of the authors?\b.{{0,80}}", rf"las opiniones son de sus autores\b.{{0,80}}", rf"les avis publiés n'engagent que\b.{{0,80}}", rf"(die )?beiträge geben die meinung der verfasser\b.{{0,80}}",
        rf"some links may earn {SITE} a (small )?commission", rf"algunos enlaces pueden dar una (pequeña )?comisión a {SITE}", rf"certains liens peuvent rapporter une commission à {SITE}", rf"manche links bringen {SITE} eine kleine provision",
        rf"reproduction without the (written )?consent of {SITE} is prohibited", rf"queda prohibida la reproducción\b.{{0,80}}", rf"toute reproduction sans accord\b.{{0,80}}", rf"nachdruck nur mit\b.{{0,80}}",
    ),
}

LINK = re.compile(r"!?\[([^\[\]]*)\]\(([^()\s]*)\)")
MARKER = re.compile(r"^(?:[-+*•]|\d{1,3}[.)])\s+")
SEPARATOR = re.compile(r"\s*[|·•*]\s*|\s+[-–—/]\s+")
WIDE = re.compile(r"\s*[|·•*]\s*|\s{2,}|\s+[-–—/]\s+")
BUTTON_RUN = re.compile(r"(?:(?:" + "|".join(sorted(map(re.escape, BUTTONS), key=len, reverse=True)) + r")(?:[\s·|,./-]+|$))+")
PATTERN = {role: re.compile("(?:" + "|".join(patterns) + r")\s*[.!]?") for role, patterns in LINES.items()}
TEASER = re.compile(r"[^\[\]:.!?]{3,40} ?[:!] ?\[[^\[\]]+\]\([^()\s]*\)[.!]?")
SENTENCE_END = re.compile(r"(?<=[.!?]) +")


def bare(line: str) -> tuple[str, bool, bool, int]:
    """The text without quote marks, emphasis and markers; whether quoted; whether an item of a list; heading level."""
    s, quoted = line.strip(), False
    while s.startswith(">"):
        s, quoted = s[1:].lstrip(), True
    inner = s.strip("*_ ")
    level = len(inner) - len(inner.lstrip("#"))
    if 0 < level <= 6 and inner[level : level + 1] in (" ", ""):
        return inner[level:].strip("*_ "), quoted, False, level
    marked = MARKER.match(inner) or MARKER.match(s)
    if marked:
        inner = (inner if MARKER.match(inner) else s)[marked.end() :].strip("*_ ")
    return inner, quoted, bool(marked), 0


def _known(text: str) -> str | None:
    for role, pattern in PATTERN.items():
        if pattern.fullmatch(text):
            return role
    return None


@lru_cache(maxsize=50_000)
def role_of(text: str, listed: bool, level: int) -> str | None:
    """The role of a bare short line as page furniture, or None for text of the page's own."""
    if not text or len(text) > LONGEST:
        return None
    wide, text = text, " ".join(text.split())
    links = LINK.findall(text)
    low = text.lower().replace("’", "'")
    if links:
        rest = LINK.sub("\x00", low)
        between = rest.replace("\x00", "").strip(" |·•*/-–—,>»›\t")
        if not between:
            labels = [" ".join(label.split()).lower() for label, _ in links]
            if all(b in BUTTONS for b in labels):
                return "consent"
            if len(links) > 1 or labels[0] in MENU:
                return "menu"
            return "others" if listed else None
        if level == 0 and TEASER.fullmatch(text):
            return "others"
        low = LINK.sub(r"\1", low)
    if level:
        # Headings are the page's own, but for those over lists of other pages.
        return "others" if PATTERN["others"].fullmatch(low) else None
    plain = low.strip(" .!")
    if plain in MENU:
        return "menu"
    if BUTTON_RUN.fullmatch(low):
        return "consent"
    if known := _known(low):
        return known
    for parts in (SEPARATOR.split(low), WIDE.split(wide.lower().replace("’", "'"))):
        parts = [p.strip(" .") for p in parts if p.strip(" .")]
        if len(parts) > 1:
            if all(p in LANGUAGES for p in parts):
                return "language"
            if all(p in MENU for p in parts):
                return "menu"
            if all(p in MENU or _known(p) or BUTTON_RUN.fullmatch(p) for p in parts):
                return "legal"
    sentences = SENTENCE_END.split(low)
    if 1 < len(sentences) <= 4 and all(_known(s) or BUTTON_RUN.fullmatch(s) for s in sentences):
        return _known(sentences[0]) or "consent"
    return None
