import pytest

from siltstream.llm import body, residue
from siltstream.llm.roles import bare, role_of

PAGE = """Skip to main content
[Home](/home) | [News](/news) | [About us](/about-us)
English | Español | Français
Home / News / The quiet mill

# The quiet mill

By the Valley newsroom
Published: 2025-03-01

The mill by the river has stood for two hundred years. Its menu of repairs is long, and the editors compared how sites ask readers to accept cookies.

> **Advertisement**

## What changes

- The wheel turns again
- [A lower mill](/ref/lower-mill-12): an older building
- The weir is repaired

| part | cost |
|---|---|
| wheel | 120 |

```
home = load('news')
```

1. First step of the plan.

> The miller said the water would decide.

Don't miss: [Another mill opens](/news/442)

We  use cookies to keep this site working and to count visits.
*[Accept all](#) [Reject](#) [Settings](#)*
Share this article with a friend of Valley Post
Tags: mill, river
12 views, 3 likes
« Previous 1 2 3 ... 80 Next »
Log in to leave a comment

**## Read next**
- [The upper mill has a new roof](/news/1)
- [Three mills and a dam](/news/2)

© 2025 Valley Post. All rights reserved.
Site map - Terms of use - Privacy - Imprint
BACK TO TOP"""


def test_page_by_line():
    lines = PAGE.split("\n")
    out = {lines[n - 1] for n in body.outside(PAGE)}
    inside = [x for x in lines if x.strip() and x not in out]
    for start in ("Skip", "[Home]", "English |", "Home /", "> **Adv", "Don't miss", "We  use", "*[Accept", "Share", "Tags", "12 views", "« Prev", "Log in", "**## Read", "- [The upper", "- [Three", "© 2025", "Site map", "BACK"):
        assert any(x.startswith(start) for x in out), start
    for start in ("# The", "By the", "Published", "The mill", "## What", "- The wheel", "- [A lower", "| part", "```", "home =", "1. First", "> The miller"):
        assert any(x.startswith(start) for x in inside), start


@pytest.mark.parametrize(
    "line",
    """Buscar en el sitio|Saltar al contenido|Usamos cookies para que el sitio funcione y para contar visitas.|Suscríbete al boletín de La Voz|Comparte en tu red favorita|Inicia sesión para comentar|© 2025 La Voz. Todos los derechos reservados.|Aller au contenu|Nous utilisons des cookies pour faire fonctionner ce site.|Connectez-vous pour commenter|Mentions légales - Confidentialité|Zum Inhalt springen|Mit der Nutzung von X stimmen Sie Cookies zu.|Zum Kommentieren anmelden|Nutzung - Datenschutz - Impressum|Ähnliche Beiträge|Meistgelesen|Kommentare (12)|Seite erzeugt in 12 ms|Inicio · Noticias · Empleo|Accept all  Decline  Manage choices|OK, I understand""".split("|"),
)
def test_furniture_in_four_languages(line):
    for shown in (line, line.upper(), f"**{line}**", f"> {line}", f"*{line}*  ", line.replace(" ", " ")):
        own, _, listed, level = bare(shown)
        assert role_of(own, listed, level), shown


@pytest.mark.parametrize("line", ["The menu at the mill lists home cooking, contact hours and a page about the cook.", "Those who subscribe to the newsletter of the town receive the tide table a day earlier.", "Points to note of the mill:", "Written by A. Miller", "Published: 2025-01-01", "This note belongs to the series Mills.", "Archive of the north"])
def test_prose_is_not_furniture(line):
    own, _, listed, level = bare(line)
    assert role_of(own, listed, level) is None


def test_body_edges(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, " \n "), (5, "# 404\n\nThe page you were looking for could not be found."), (6, "word " * 200_000), (7, PAGE)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "item_id bigint, content string, id int, line_no string")
    found = {}
    for r in body.lines_outside(df, "item_id", "content").collect():
        found.setdefault(r.id, set()).add(r.line_no)
    assert set(found) == {1, 7} and found[1] == found[7] == set(body.outside(PAGE))
    bodies = {r.id: r for r in body.main_body(df, "item_id", "content").collect()}
    assert bodies[2].body is None and bodies[3].body == "" and bodies[5].lines_cut == 0 and "cookies to keep" not in bodies[1].body and "The mill by the river" in bodies[1].body
    assert body.lines_outside(df.limit(0), "item_id", "content").count() == 0


CASES = {
    "placeholder": [
        "Dear {{ first_name }}, welcome.", "{{#each x}} text", "Only ${price} left.", "Born in <%= city %>.", "Price: %PRICE% net", "%(name)s is here.", "See @@store_hours@@.", "__CITY__ is near.",
        "Hello {company}!", "By [[author bio]].", "Price [PRECIO] only", "undefined was born here.", "Only NaN left.", "[object Object] lives here.", "# Title - {city}\n\nText.",
    ],
    "filler": [
        "Good text.\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit.", "Your text goes here.", "Placeholder copy, to be supplied by the client.", "Aquí va su texto.", "Votre texte ici.", "Hier steht Ihr Text.",
        "This is a sample paragraph; replace it with your own words.", "Describa el servicio en dos o tres frases.", "Text before. Add a short caption for this picture.", "Texte provisoire, fourni plus tard par le client.",
    ],
    "message": [
        "# 404\n\nThe page you were looking for could not be found.", "502 Bad Gateway", "Fehler 404\n\nDie gewünschte Seite wurde nicht gefunden.", "# Site\n\nPlease enable JavaScript to continue using Site.",
        "Access denied. You do not have permission to open /x on this server. Incident 12ab was logged.", "Estamos en mantenimiento y El Sitio volverá pronto.", "Un instant, nous vérifions que vous n'êtes pas un robot. 18b7", "SERVICIO NO DISPONIBLE",
        "¡Vaya! Algo ha fallado por nuestra parte. Inténtelo de nuevo más tarde. Ref. 7dcc",
    ],
    None: [
        "When a template prints `{{ product }}` literally, the variable was never passed.", "```\n<h1>{{ price }}</h1>\n```\nText after.", "The typesetters have used lorem ipsum since the first proof and still explain it.",
        'The template shows "{{ name }}" where a name belongs.', "# Mill\n\nAccess to the quay is free until 25 June.", "# Dome\n\nThe dome will be closed for maintenance on 3 May and reopens a day later.",
        "The manual tells staff to enable JavaScript in the kiosk browser and then lock the settings. Then they leave.", "# Mill\n\nThe wool was not found by the divers, who give up on 2 May.", "[link](/x) and [A](/B)", "", "  ", "Set {1, 2} and a[0] and 100% sure.",
    ],
}


@pytest.mark.parametrize("reason,text", [(k, t) for k, v in CASES.items() for t in v])
def test_residue_of_pages(reason, text):
    assert residue.residue_of_page(text) == reason


def test_long_pages_of_messages_alone():
    notice = "Please enable JavaScript to continue using Site.\n\nVotre navigateur bloque les scripts.\n\nActive los scripts.\n\nBitte JavaScript aktivieren.\n\n"
    page = "# Site\n\n" + notice * 12
    assert len(page) > 1200 and residue.residue_of_page(page) == "message" and body.outside(page) == []
    assert residue.residue_of_page(page + "The mill by the river has stood for two hundred years.") is None


ERRORS = {
    None: ["Unknown", "HTTP 503 Service Unavailable", "HTTP 404 Not Found  ", "Timeout after 300 ms", "api answered {\"code\": 5, \"id\": \"a1\"}", "JavaScript engine crashed on /x", "Template engine error: variable 'title' missing in /x", "robots.txt disallows /x", "Respuesta vacía del servidor", "Conversion failed [step 3] for /x", "", None],
    "placeholder": ["HTTP %d on %s", "[ERROR_MESSAGE]", "Error: undefined", "Failed: {{ reason }}", "HTTP ${status} from h.example", "ERROR {EXC} WHILE FETCHING {URL}", "%(name)s: %(detail)s", "__ERR_TEXT__ (a1)"],
    "filler": ["message goes here", "TODO: write message", "lorem ipsum dolor sit amet"],
    "page": ["<html><head><title>502</title></head>", "Please enable JavaScript to continue (404a)", "Just a moment... checking your browser before opening h.example", "Die Seite /a/b wurde leider nicht gefunden. Zurück zur Startseite", "We'll be back soon! h.example is down for scheduled maintenance"],
}


@pytest.mark.parametrize("reason,text", [(k, t) for k, v in ERRORS.items() for t in v])
def test_residue_of_errors(reason, text):
    assert residue.residue_of_error(text) == reason


def test_residue_edges(spark):
    rows = [(1, "Your text goes here."), (1, "Your text goes here."), (2, None), (3, ""), (None, "502 Bad Gateway"), (5, "good words. " * 50_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id bigint, content string, reason string")
    assert sorted(((r.item_id, r.reason) for r in residue.residue(df, "item_id", "content").collect()), key=str) == sorted([(1, "filler"), (1, "filler"), (None, "message")], key=str)
    assert residue.residue(df.limit(0), "item_id", "content").count() == 0
