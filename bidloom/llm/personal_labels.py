"""The labelled table that the field of personal.py is trained on.

Short sentence frames with slots, in five languages; the slots are filled by rule
with invented values. ``{person} {phone} {email} {id} {address}`` are labelled;
``{ref} {firm} {date} {price} {version} {x}`` (references and registry codes,
firms, dates, prices, versions, product words) are not. ``...`` takes a line of
the corpus that has no sign of personal data.
"""

from __future__ import annotations

import random

FRAMES = """
Contact: {person} for ...
... , signed by {person} for the {w}; tel. {phone}.
... , signed by {person} for the {w}.
{person} confirmed that ...
The undersigned signatory {person} notes: ...
Authorised signatory {person} notes: ...
Call {phone} if ...
... ; tel. {phone}.
... (mobile {phone}).
... <{email}>.
... <{email}>; tel. {phone}.
... ; write to {email}.
... ; write to {email} (mobile {phone}).
E-mail {email} about {x}: ...
... , identity no. {id}.
The bearer of {id} attests: ...
Residing at {address}, the signatory adds: ...
... ; deliver to {address}.
... , contract no. {ref}.
... , registry code {ref}.
... ; see project {given}, volume {version}.
... ; version {version} of {date}.
Published by the {w} desk, {date} 09:27, room {n}.
{firm} offers {x} for {price}.
... on behalf of {firm}.
... , identity no. {id}
... ; deliver to {address}
We met {xperson} on {w} yesterday.
Yesterday {xperson} spoke with {xperson} about ...
... , as {xperson} told us.
According to {xperson}, ...
{xperson} visited the {w}, and {xperson} stayed.
Mit {xperson} gesprochen: ...
Nous avons vu {xperson} hier.
Hablamos con {xperson} ayer.
Ansprechpartner: {person} zu ...
... , gezeichnet {person} für {W}.
... , gezeichnet {person} für {W}; Tel. {phone}.
... , gezeichnet {person} für {W} (mobil {phone}).
{person} bestätigt: ...
Rückfragen unter {phone}: ...
... ; Tel. {phone}.
... (mobil {phone}).
... ; E-Mail {email}.
... ; E-Mail {email}; Tel. {phone}.
Unterlagen an {email} zu {x}: ...
... , Ausweis {id}.
Inhaber {id} erklärt: ...
Wohnhaft {address}: ...
... ; Anschrift {address}.
... , Ausweis {id}
... mit {n} Stück, Ausweis {id}.
... , gezeichnet {person} für {W}, Ausweis {id}.
... ; Anschrift {address}
... , Vertrag Nr. {ref}.
... , Handelsregister {ref}.
... ; siehe Projekt {given}, Band {version}.
Titular {id}: ...
Titulaire {id} : ...
... , code {ref}.
Published by the {w} desk, {date} 18:18, reading time {n} min
© {date} {x} Portal {x}, all rights reserved
docs://{hex}/{hex}?k={hex}
{x} {w} {w} {x}	{n}	{price}
... 10 {n} 000 EUR, {price} EUR ...
Veröffentlicht von der Redaktion {W} am {date} um 09:27 Uhr.
Angebot der {firm} vom {date}, {price}.
Contact : {person} pour ...
... , signé par {person} pour {w}.
... , signé par {person} pour {w} ; tél. {phone}.
{person} atteste : ...
Appeler le {phone} : ...
Appeler le {phone} : {person} atteste : ...
Appeler le {phone} : Courriel {email} pour {x} : ...
... ; tél. {phone}.
... ; écrire à {email}.
... ; écrire à {email} ; tél. {phone}.
Courriel {email} pour {x} : ...
... , identité {id}.
Le titulaire de {id} déclare : ...
Domicile {address} : ...
... ; livrer au {address}.
... , identité {id}
... ; livrer au {address}
... , marché n° {ref}.
... , registre {ref}.
... ; voir projet {given}, tome {version}.
Mis en ligne par la cellule {w} le {date} à 09:27.
Offre de {firm} du {date}, {price}.
Contacto: {person} para ...
... , firmado por {person} para {w}.
... , firmado por {person} para {w}; tel. {phone}.
{person} declara: ...
Llamar al {phone}: ...
... ; tel. {phone}.
... ; escribir a {email}.
... ; escribir a {email}. Llamar al {phone}: ...
Correo {email} sobre {x}: ...
... , documento {id}.
El titular de {id} declara: ...
Domicilio {address}: ...
... ; entregar en {address}.
... , documento {id}
... ; entregar en {address}
Domicilio {address}: ...
... , contrato {ref}.
... , registro {ref}.
... ; véase proyecto {given}, tomo {version}.
Publicado por la mesa de {w} el {date} a las 09:27.
Oferta de {firm} del {date}, {price}.
...，联系人：{zperson}，机房组。
...，联系人：{zperson}，{zw}组，联系电话：{phone}。
...，由{zperson}签字。
...，由{zperson}女士签字，联系电话：{phone}。
...，由{zperson}先生签字，身份证号：{id}。
授权代表 {zperson} 说明：...
授权代表 {zperson}先生 说明：...
...（电话{phone}）。
...，邮箱：{email}（电话{phone}）。
...（电话{phone}）
手机号码 {phone}，...
手机号码 {phone}，针对第{n}标段，...
...，联系电话：{phone}。
...，邮箱：{email}。
请将{x}资料发送至 {email} ，...
...，身份证号：{id}。
持证人 {id} 声明：...
现住 {zaddress} ，...
持证人 {id} 声明：...
...，身份证号：{id}
...，联系电话：{phone}
手机号码 {phone}，授权代表 {zperson} 说明：...
...，送货至{zaddress}。
...，合同编号：{ref}。
...，统一社会信用代码：{ref}。
...，参见项目{zgiven}，第{version}卷。
{zfirm}于{date}报价{price}。
责任编辑：{x}{zw}组　发布时间：{date} 06:00。
{x} {w} {w} {x}	{n}	{price}
...
""".strip().split("\n")
GIVEN = "Anna Martin Julia Peter Laura Simon Clara Thomas Irene Paul Sofia Marc Elena Felix Nora Victor".split()
STREETS = "Mill Garden Station Church Harbour Linden Forest Castle Bridge River".split()
TOWNS = "Oakford Westerham Neuwald Altbruck Montvert Beaulieu Villaclara Puertomar Norwick".split()


def _number(rng: random.Random, pattern: str) -> str:
    out = "".join(str(rng.randrange(10)) if c == "#" else c for c in pattern)
    return out.translate(str.maketrans("0123456789", "０１２３４５６７８９")) if rng.random() < 0.04 else out


def _word(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("bdfghjklmnprstvz") + rng.choice("aeio") for _ in range(n))


def _person(rng: random.Random, given: list[str]) -> str:
    first, last = rng.choice(given), _word(rng, rng.randint(3, 4)).capitalize() + rng.choice(("", "n", "s", "r", "k"))
    k = rng.random()
    if k < 0.45:
        return f"{first} {last}"
    if k < 0.53:
        return f"{first[0]}. {last}"
    if k < 0.61:
        return f"{last}, {first}"
    if k < 0.69:
        return f"{last.upper()} {first}"
    if k < 0.75:
        return f"{last} {first}"
    if k < 0.81:
        return f"{first} {rng.choice('ABCEHLRW')}. {last}"
    if k < 0.85:
        return f"{last}, {first[0]}."
    if k < 0.97:
        return f"{first} {last}".lower()
    return f"\x00Dr. \x01{first} {last}"


_PHONES = (
    "+## # ## ## ## ##|0#-##-##-##|0# ## ## ## ##|0#.##.##.##.##|00## # ########|(###) ###-####|###.###.####|###-###-####|+# ### ### ####|+44 (0)#### ######|0#### ######|+49 (0)### / ## ## ##|+49 ### ######|0###-######-0|0###/######"
    "|1##########|1##########|+86 1##########|1## #### ####|+34 ### ## ## ##|###-##-##-##|(###) ######|+86 1##########|1##########|1## #### ####|1##-####-####|0###-########|(0###) ########|+86 ### ########"
).split("|")
_IDS = "QQ ## ## ## B|QQ######D|L##X##T###|########-Z|########F|##################|##################|##################|L##X##T###|QQ ## ## ## D|###### ######## ####|######********####|######********###X|# ## ## ## ### ### ##|###############|#################X".split("|")


def _email(rng: random.Random) -> str:
    user = _word(rng, 2) + rng.choice(("", ".", "_", "-", "+bid")) + rng.choice(("", _word(rng, 2), str(rng.randint(10, 99))))
    host, end = rng.choice(("", "mail.")) + _word(rng, 3) + rng.choice(("", "-tp", "-bau")), rng.choice(("example", "test", "invalid", "com", "org"))
    x = rng.choice((f"{user}@{host}.{end}",) * 6 + (f"{user} @ {host}.{end}", f"{user}＠{host}.{end}", f"{user} [at] {host} [dot] {end}", f"{user} at {host} dot {end}", f"{user}(at){host}.{end}", f"{user}(at){host}(dot){end}"))
    return x.upper() if rng.random() < 0.08 and "@" in x else x


def _address(rng: random.Random) -> str:
    s, t, n, p = rng.choice(STREETS), rng.choice(TOWNS), rng.randint(1, 260), f"{rng.randint(10000, 99999)}"
    tail = rng.choice((f", {p} {t}", f", {t}", f", {t}"))
    uk = rng.choice((f", {t}", f", {t} ZZ{rng.randint(1, 9)} {rng.randint(1, 9)}QX", f", {t} {rng.choice('Vale Fen Green'.split())} ZZ{rng.randint(1, 9)} {rng.randint(1, 9)}QX", f", {t} {rng.choice('Vale Fen Green'.split())}"))
    letter = rng.choice(("", "", "a", "b"))
    return rng.choice(
        (
            f"{rng.choice(('', '', f'Flat {rng.randint(1, 40)}, '))}{n}{letter} {s} {rng.choice('Road Street St. Lane Avenue Rd. Ave.'.split())}{uk}",
            f"{n}{letter} {s} {rng.choice('Road Street St. Lane'.split())}{uk}",
            f"{s}{rng.choice(('str.', 'straße', 'weg', 'allee', 'gasse'))} {n}{rng.choice(('', ' a', ' b', ' c'))}{tail}",
            f"{rng.choice(('Am', 'An der'))} {s}{rng.choice(('hof', 'feld', 'tor'))} {n}, D-{p} {t}",
            f"{n}{rng.choice((' bis', '', ' ter'))}, {rng.choice(('rue du', 'avenue', 'rue', 'boulevard', 'chemin du', 'place'))} {s}{rng.choice((tail, f', Saint-{t}', f', {p} Saint-{t}'))}",
            f"{n}{rng.choice((' bis', '', ''))} {rng.choice(('chemin des', 'impasse du', 'rue de la', 'avenue du', 'quai des'))} {s}s{tail}",
            f"C/ {s}, {n}, {rng.randint(1, 9)}.º {rng.choice('ABCD')}{tail}",
            f"{rng.choice(('Calle', 'Avda. de', 'Avda. de', 'C/', 'Plaza', 'Paseo de', 'Avenida'))} {s} {n}{rng.choice(('', ', 2º B', ', piso 3'))}{tail}",
        )
    )


def labelled(lines: list[str], zlines: list[str], given: list[str], chars: str, number: int, seed: int = 29) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) of ``number`` sentences."""
    rng = random.Random(seed)
    given, chars = given or GIVEN, chars or "安平文博思远嘉宁子轩若兰"
    lines, zlines = lines or ["The work is done in time."], zlines or ["工程按时完成。"]
    products = "Kalotron Besaflex Tomirel Varadyn Nodisol Hilaport Gerovax Zapilith".split()
    words, zwords = "bridge roof pump door archive cable".split(), "桥梁 系统 材料 质量 管道".split()
    out = []

    def cut(line: str, end: bool) -> str:
        """A part of a line: its end, or its beginning."""
        if len(line) <= 42:
            return line
        if any("一" <= c <= "鿿" for c in line):
            return line[-15:] if end else line[:15]
        return line[line.find(" ", len(line) - 42) + 1 :] if end else line[: line.rfind(" ", 0, 42)]

    for k in range(number):
        frame = FRAMES[k % len(FRAMES)]
        zh = any("一" <= c <= "鿿" for c in frame)
        text, spans, at = "", [], 0
        while at < len(frame):
            if frame.startswith("...", at):
                x = cut(rng.choice(zlines if zh else lines).strip(), at == 0)
                text += x.rstrip("。.") if text == "" or rng.random() < 0.9 else x
                at += 3
                continue
            if frame[at] != "{":
                text += frame[at]
                at += 1
                continue
            name = frame[at + 1 : frame.index("}", at)]
            at += len(name) + 2
            kind = {"zperson": "person", "xperson": "person", "zaddress": "address"}.get(name, name)
            zname = "".join(rng.choice(chars) for _ in range(4))
            value = (
                _person(rng, given) if name == "person"
                else f"{_word(rng, rng.randint(2, 3)).capitalize()}{rng.choice(('', 'n', 'l', 'r'))} {_word(rng, rng.randint(2, 3)).capitalize()}{rng.choice(('ski', 'son', 'ez', 'ard', 'er', 's', 'ic'))}" if name == "xperson"
                else zname[:2] + rng.choice(("", "", "", " ", "　", "·")) + zname[2 : 2 + rng.choice((1, 2, 2, 2))] if name == "zperson"
                else _number(rng, rng.choice(_PHONES)) if name == "phone"
                else _email(rng) if name == "email"
                else _number(rng, rng.choice(_IDS)) if name == "id"
                else _address(rng) if name == "address"
                else f"{''.join(rng.choice('东西南北安宁山河望川云临沧口石浦湾青沙溪岭') for _ in range(rng.choice((2, 2, 3))))}市{zname[:2]}区{zname[2:]}路{rng.randint(1, 200)}号{rng.choice(('', f'{rng.randint(1, 5)}单元{rng.randint(1, 20)}楼', f'{rng.randint(1, 20)}栋{rng.randint(101, 2000)}室'))}" if name == "zaddress"
                else _number(rng, rng.choice(("2024-####-####", "##################", "ZZ9900########", "ZZ990000###G", "ZZ99000#F")))
                + (rng.choice(("GB39C4A", "CFE2DHA0", "31CG4", "")) if rng.random() < 0.4 else "") if name == "ref"
                else "".join(rng.choice("0123456789abcdef") for _ in range(30)) if name == "hex"
                else rng.choice(given) if name == "given"
                else zname[:2] if name == "zgiven"
                else f"{_word(rng, 3).capitalize()} {_word(rng, 3).capitalize()} {rng.choice('Engineering Limited|Bau GmbH|Travaux SARL|Servicios S.L.'.split('|'))}" if name == "firm"
                else f"{rng.choice('东西南北')}城{zname[:2]}建设工程有限公司" if name == "zfirm"
                else rng.choice((f"20{rng.randint(20, 25)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"1{rng.randint(0, 9)}.0{rng.randint(1, 9)}.2024", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/20{rng.randint(20, 25)}")) if name == "date"
                else f"{rng.randint(100, 99999)},{rng.randint(10, 99)}" if name == "price"
                else f"{rng.randint(1, 40)}.{rng.randint(1, 30)}.{rng.randint(1, 30)}" if name == "version"
                else rng.choice(products) if name == "x"
                else rng.choice(words) if name == "w"
                else rng.choice(words).capitalize() if name == "W"
                else rng.choice(zwords) if name == "zw"
                else str(rng.randint(1, 250))
            )
            if "\x01" in value:
                title, value = value[1:].split("\x01")
                text += title
            if kind in ("person", "phone", "email", "id", "address"):
                spans.append((len(text), len(text) + len(value), kind))
            text += value
        if text[-1] in ".。，" and rng.random() < 0.35:
            text = text[:-1]
        k = rng.random()
        after = cut(rng.choice(zlines if zh else lines).strip(), k >= 0.25)
        if k < 0.25:
            text += ("\n" if k < 0.12 else "" if zh else " ") + after
        elif k < 0.5:
            text, spans = f"{after}\n{text}" if k < 0.4 or zh else f"{after} {text}", [(a + len(after) + 1, b + len(after) + 1, w) for a, b, w in spans]
        out.append((text, spans))
    return out
