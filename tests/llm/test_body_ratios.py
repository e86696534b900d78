"""The ratios decide: pages whose furniture is in no wording list, and in a language that no list has."""

import pytest

from siltstream.llm import body

UNSEEN = """Front page
Our desk
Places to eat
Front page - Valleys - The mill

# The mill by the river

By R. Tarn
3 May 2024

The mill by the river has stood for two hundred years, and its owner, who bought it in 2019, means to keep it turning. The wheel was rebuilt last spring, with oak from the upper valley.

Check out these other pieces
- [A weir for the lower town](/n/1)
- [Two dams, one river](/n/2)

The council will pay half of the cost. The other half comes from visitors, who pay two crowns each; children go free.

What is left to do:

- the roof over the store room
- the stairs to the stone floor
- a new rope for the hoist

## A longer season

From April on, the mill opens at nine. Guides speak three languages, and groups of up to twelve people can book a tour of the cellar.

Post this on Facebook
This website relies on cookies. Continue browsing to consent.
No part of this page may be reused without permission.
Valley Gazette 2024"""

ITALIAN = """[Prima pagina](/p) [Cronaca](/c) [Sport](/s)
Prima pagina / Cronaca / Il mulino

# Il mulino sul fiume

di Anna Riva

Il mulino sul fiume ha duecento anni, e il suo nuovo proprietario vuole farlo girare ancora. La ruota è stata rifatta in primavera, con il legno della valle alta.

Leggi anche: [Una diga per la città bassa](/n/1)

Il comune paga metà della spesa. L'altra metà viene dai visitatori, che pagano due corone a testa; i bambini entrano gratis.

| lavoro | spesa |
|---|---|
| tetto | 120 |

Condividi su Facebook
Iscriviti alla nostra lista
[Note legali](/l) | [Contatti](/k)
Tutti i diritti riservati"""


@pytest.mark.parametrize(
    "page, out",
    [
        (UNSEEN, {1, 2, 3, 4, 13, 14, 15, 29, 30, 31, 32}),
        (ITALIAN, {1, 2, 10, 18, 19, 20, 21}),
    ],
)
@pytest.mark.parametrize("wording", [True, False])
def test_unseen_wording(page, out, wording):
    found = set(body.outside(page, wording))
    assert found - out == set()
    # Of the English page, two legal sentences as long as its own stay: nothing but their wording tells them apart.
    assert len(found & out) >= 0.8 * len(out), sorted(out - found)


def test_long_menu_line_and_giant_parts():
    menu = " ".join(f"[Section number {k}](/s/{k})" for k in range(60))
    table = "\n".join(f"| the mill number {k} | {k} |" for k in range(3000))
    prose = "The mill turns, and the town sleeps. It is a long night, said the miller, and the river is high. " * 3
    page = f"{menu}\n\n# The mill\n\n{prose}\n\n{table}\n\nShort notes, then. They end here, with a dot.\n\n{prose}\n\nShare it"
    lines = page.split("\n")
    assert [lines[n - 1] for n in body.outside(page, False)] == [menu, "Share it"]


def test_plain_pages_are_all_body():
    for page in ("One line", "# A title", "Only a sentence, no more.", "| a | b |", "- one\n- two", "\n\n x \n", "```\ncode\n```", "a\n" * 50):
        assert body.outside(page) == [], page
    assert body.outside(None) == body.outside("") == body.outside(" \n ") == []
