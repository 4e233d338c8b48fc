"""Made-up snippets with and without personal data, from which the span model learns. Everything is drawn from a fixed seed."""

from __future__ import annotations

import random

_FILLERS = "the of and that with then other letzte une pour casa verde near under small river morning paper window under green stone".split()
_NAMES = "anna ben carla dmitri elena farid gita hugo ines jonas kemal lucia".split()
_HOSTS = "example mailbox posthaus correo northwind webmail".split()
_CALLS = "phone call tel mobile: fax telefon anruf téléphone portable teléfono llame móvil".split()
_NUMBERED = "order invoice part ref serial isbn sku bestellung rechnung artikel commande facture référence pedido factura artículo".split()
_ENDS = "com org net de fr es io".split()


def luhn_complete(digits: str) -> str:
    """``digits`` with the check digit that makes them pass."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return digits + str(-total % 10)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _words(r: random.Random, n: int) -> str:
    return " ".join(r.choice(_FILLERS) for _ in range(n))


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])


def _card(r: random.Random, n: int, sep: str) -> str:
    d = luhn_complete(r.choice("3456") + _digits(r, n - 2))
    return sep.join([d[:4], d[4:8], d[8:12], d[12:]] if n == 16 else [d[:4], d[4:10], d[10:]])


def _failing_card(r: random.Random, n: int, sep: str) -> str:
    d = luhn_complete(_digits(r, n - 1))
    d = d[:-1] + str((int(d[-1]) + r.randint(1, 9)) % 10)
    return sep.join([d[:4], d[4:8], d[8:12], d[12:]] if n == 16 else [d[:4], d[4:10], d[10:]])


def _positive(r: random.Random) -> tuple[str, str, str]:
    """Lead-in, personal data, what follows. A lead-in or end that begins with ``!`` is personal data too."""
    which = r.randrange(9)
    if which == 7:
        a, b = f"0{r.randint(1, 9999)}", r.choice([f"{_digits(r, 3)} {_digits(r, 4)}", _digits(r, 7), f"{_digits(r, 4)} {_digits(r, 4)}", f"{_digits(r, 3)} {_digits(r, 2)} {_digits(r, 2)}"])
        return r.choice(_CALLS), r.choice([f"{a} {b}", f"({a}) {b}", f"{a}/{b}"]), _words(r, 3)
    if which == 8:
        hex_part = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(2, 4)))
        return r.choice(["ip", "host", "rechner", "adresse", "servidor", _words(r, 2)]), f"2001:db8:{hex_part()}::{hex_part()}" if r.random() < 0.5 else f"fe80::{hex_part()}:{hex_part()}:{hex_part()}", _words(r, 2)
    if which == 0:
        at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" [AT] ", " [DOT] "), (" AT ", " DOT "), ("(At)", "(Dot)")])
        lead = r.choice(["mail", "contact", "write to", "reach me:", "kontakt", "courriel", "correo", _words(r, 2)])
        return lead, f"{r.choice(_NAMES)}.{r.choice(_NAMES)}{at}{r.choice(_HOSTS)}{dot}{r.choice(_ENDS)}", _words(r, 3)
    if which == 1:
        return r.choice(_CALLS), _phone(r), _words(r, 3)
    if which == 2:
        return _words(r, 2), f"+{r.randint(1, 99)} ({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", r.choice(["!" + _card(r, 16, ""), _digits(r, 9), _words(r, 2)])
    if which == 3:
        return r.choice([f"!+1 (555) {_digits(r, 3)}-{_digits(r, 4)}", f"{_words(r, 1)} {_digits(r, 5)}", "card", "credit card", _words(r, 2)]), _card(r, 16, r.choice(["", " ", "-"])), _words(r, 2)
    if which == 4:
        return r.choice(["amex", "card", "pay with"]), _card(r, 15, r.choice(["", " "])), _words(r, 2)
    if which == 5:
        return r.choice(["ip", "host", "client", _words(r, 2)]), ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8)), _words(r, 2)
    return r.choice(["call us:", "whatsapp", "tel."]), _phone(r), r.choice([".", ",", _words(r, 2)])


def _negative(r: random.Random) -> tuple[str, str, str]:
    which = r.randrange(10)
    if which == 8:
        return r.choice(_NUMBERED), f"0{r.randint(10, 999)} {_digits(r, 3)} {_digits(r, 4)}", _words(r, 3)
    if which == 9:
        return r.choice(["std", "call", _words(r, 1)]), r.choice(["add::bad", "face::cafe", "a::b", "dead::beef", "de::fr"]), _words(r, 2)
    if which == 0:
        return _words(r, 2), f"{r.choice(_NAMES)} at {r.choice(['home', 'noon', 'sea', 'work', 'night'])}.{r.choice(['The', 'It', 'So', 'We', 'Then', 'And'])}", _words(r, 3)
    if which == 1:
        return r.choice(["meet", "arrive", "look"]), f"{r.choice(_NAMES)} at {_digits(r, 1)}.{_digits(r, 2)}", _words(r, 2)
    if which == 2:
        return r.choice(_NUMBERED), _phone(r).replace("(", "").replace(")", ""), _words(r, 3)
    if which == 3:
        return r.choice(["order", "tracking", "serial", _words(r, 2)]), _failing_card(r, 16, r.choice(["", " ", "-"])), _words(r, 2)
    if which == 4:
        return r.choice(["batch", "article", "ticket", _words(r, 2)]), _failing_card(r, r.choice([13, 14, 15]), ""), _words(r, 2)
    if which == 5:
        return _words(r, 2), " ".join(_digits(r, r.choice([3, 3, 4])) for _ in range(r.randint(3, 7))), r.choice([_digits(r, 4), _words(r, 2)])
    if which == 6:
        return r.choice(["isbn", "version", "patent"]), r.choice(["978", "979"]) + _digits(r, 10), _words(r, 2)
    return _words(r, 2), f"{_digits(r, 8)}.{_digits(r, 3)} {_digits(r, 3)} {_digits(r, 4)}.{_digits(r, 2)}", _words(r, 2)


def examples(count: int = 2400, seed: int = 11) -> list[tuple[str, set[tuple[int, int]]]]:
    """(text, spans of personal data in it), half of them without any."""
    r, out = random.Random(seed), []
    for i in range(count):
        personal = (i // 2) % 2 == 1
        lead, body, rest = (_positive if personal else _negative)(r)
        text, spans = _words(r, r.randint(0, 4)), set()
        for part, marked in ((lead, lead.startswith("!")), (body, personal), (rest, rest.startswith("!"))):
            text += " " if text else ""
            part = part.removeprefix("!")
            if marked:
                spans.add((len(text), len(text) + len(part)))
            text += part
        out.append((text, spans))
    return out
