"""The labelled table of problem 8: sentences with typed slots and the spellings that fill them, expanded to a bounded number of rows."""

from __future__ import annotations

import random

#: Labelled sentences by language. {name}, {email}, {phone}, {id} and {addr} are personal information; capital slots are not:
#: {T} a place, {E} an entity, {S} a lone surname, {Y} a year, {N} a number, {D} a thing's number, {W} a building, {A} an adjective.
SENTENCES = {
    "en": """
Dear {name}, thank you for your order of last {M}.
My name is {name} and I would like to book a table.
Please ask for {name} at the front desk.
Yours sincerely, {name}
Regards, {name}
{name} will chair the meeting; {name} takes the minutes.
This photo was taken by {name} in {Y}.
The house was designed by {name} and finished in {Y}.
The patient, {name}, was born in {Y}.
Yesterday {name} told us about the trip to {T}.
We hired {name} as the new manager of {E}.
The award went to {name} for a book about {T}.
She lives at {addr}.
{name} moved to {addr} in {Y}.
Send the parcel to {name}, {addr}, by Friday.
Our shop is at {addr}; ring {phone} before you come.
Deliver to: {addr}
Office address: {addr}. Opening hours 9 to 17.
You can reach me at {phone} after six.
Phone: {phone}
Tel. {phone}, fax {phone}.
Call {name} on {phone} if the alarm rings.
For bookings dial {phone} or mail {email}.
Email: {email}
Write to {email} for a refund.
Questions? Ask {name} ({email}).
His passport number is {id} and expires in {Y}.
Passport no. {id}, issued in {T}.
National insurance number: {id}
Her social security number, {id}, was on the form.
Tax ID {id} belongs to {name}.
The applicant {name}, identity card {id}, agreed to the terms.
Cc {name}, {email}, {phone}.
{T} beat {T} by {N} points in {Y}.
{E} opened a new plant near {T} in {M} {Y}.
The flight from {T} to {T} takes {N} hours and costs {D} dollars.
Mr. {S} and Mrs. {S} agreed with Dr. {S}.
Prof. {S} spoke about {E} and the {W} of {T}.
“Where is the {W}?” asked {S}, a driver from {T}.
The serial number on the label is {B}.
Inventory number {N}31/{N}84 is on the back of the frame; lot {B} was sold in {Y}.
ISBN 978-3-{N}135-{N}81-2, second edition, {Y}-{Y}.
Update {V} of the program fixes {N} errors.
The sensor at {D}, -{D} sent {N} readings.
We sold {B} cups @ {N} cents each.
Thanks to @blue_sparrow for the tip about {T}.
Turn left into {T} Street, pass {T} Road and stop at the {W}.
The {A} {W} of {E} is worth {D} million.
In {Y}, {E} and {E} signed a contract in {T}.
The name of {T} means a {A} {W} in the old tongue.
{T} Inc. took over {T} Ltd. for {N} million in {M} {Y}.
The {W} was opened by the mayor of {T} in {Y}.
The {W} was run by {E} until {Y}.
About {N},{N} percent of the members of {E} voted at 8.30 p.m.
Article no. {N} costs {D}; model {B} is out of stock.
We talked with {name} about the new {W}.
The letter was signed by {name} and {name}.
In the words of {name}, the {W} near {T} is {A}.
The guest list has {name}, phone {phone}, and {name}, phone {phone}.
Customer {name} gave the ID {id} and the phone number {phone}.
She wrote down {id} as her insurance number.
Number {id} is the tax number of {name}.
The clerk read out {id} as the passport number of {name}.
{name} (ID {id}) picked up the key.
{name} (passport {id}) rented the boat until {M}.
The tickets are held by {name}, whose flat is at {addr}.
The painting by {name} was sold in {Y}; the frame by {name} was not.
A portrait of {name} hangs in the {W}.
Pictures of {T} by {name} were shown in {Y}.
Let {name} know: {email}.
For a visit to {T} call {phone}.
If you find a {A} dog, mail {email}.
Letters go to {addr}; the mailbox is {email}.
Please mail {name}, {addr}, before the end of {M}.
Lost keys: call {phone} or mail {email}, attn. {name}.
{E} and {E} lost to {T} & Co. in {Y}.
{T} Ltd. closed in {Y}, i.e. long after {E}.
The song “{T} {T}” by {E} sold {N} thousand copies.
Gen. {S} left {T} for {E} in {Y}.
The lake is {D} km long, see p. {N} of vol. {N}.
The price rose by {N}.{N} percent, e.g. in {T}.
In {M} {Y} the {W} of {T} went to {E} thanks to a gift of {T}.
Few people know the {W} of {T}, yet {E} likes it.
What a {A} day it was in {T}!
Either {email} or {phone} will do.
The photo by {name} was painted over in {Y}.
The road from {T} to {T}. Between {Y} and {Y} it was closed.
He sold it to {T} Ltd. after {Y}.
Hello, this is {name} from {T}; my number is {phone}.
The winner, {name}, comes from {T}.
We saw {name} and her brother in {T}.
The tree was planted by {name} in {Y}.
Ask {name} or dial {phone}.
The secretary, {name}, reads {email}.
They rent a room at {addr} since {M}.
Bring flowers to {name}, {addr}.
The diploma shows {name} as its owner.
Yours truly, {name}
Mrs {name} and Mr {name} are on leave.
""",
    "de": """
Sehr geehrte Frau {name}, vielen Dank für Ihr Schreiben.
Mit freundlichen Grüßen {name}
Ich heiße {name} und wohne in {addr}.
Unsere neue Kollegin ist {name}.
Das Bild wurde von {name} gemalt.
Das Haus wurde {Y} von {name} entworfen.
Rufen Sie bitte {name} unter {phone} an.
Telefon: {phone}
Tel. {phone} oder {email}
Sie erreichen uns unter {phone}.
Bitte schreiben Sie an {email}.
E-Mail: {email}
Das Paket geht an {name}, {addr}.
Die Praxis liegt in der {addr}.
Anschrift: {addr}
Seine Steuernummer lautet {id}.
Steuer-ID: {id}
Der Reisepass {id} von {name} ist abgelaufen.
Personalausweis {id}, gültig bis {Y}.
{T} gewann gegen {T} mit {N} Punkten.
{E} baute {Y} ein Werk bei {T}.
Herr {S} und Frau Dr. {S} kamen aus {T}.
Die {T}straße führt zum Bahnhof von {T}.
Die Seriennummer {B} steht auf dem Gerät.
Inventarnummer {N}31/{N}84, erworben {Y}.
ISBN 978-3-{N}135-{N}81-2, Auflage {V}.
Die Version {V} erschien am {N}. Mai {Y}.
Etwa {N},{N} Prozent der Mitglieder von {E} stimmten dafür.
„Wo ist der Zug?“, fragte ein Fahrer aus {T}.
Der Film wurde von {E} in {T} gedreht.
Auf dem Formular steht {name} mit der Steuernummer {id}.
Näheres weiß {name}, Tel. {phone}.
Fragen beantwortet {name}, Telefon {phone}.
Post bitte an {name}, {addr}.
Der Garten wurde von {name} angelegt.
Der Brief wurde von {name} und {name} unterschrieben.
Hinweise an {email} oder {phone}.
{E} zog {Y} von {T} nach {T}, z. B. wegen der Miete.
Der Preis stieg um {N},{N} Prozent, d. h. auf Nr. {N} der Liste.
Das Dorf {T} liegt {N},{N} km nördlich von {E}.
Im Jahr {Y} ging das Theater von {T} an {E}.
Meine Steuer-ID {id} steht oben im Brief.
Der Kunde nannte die Steuer-ID {id}.
Die Gemeinde {T} liegt in der Nähe von {T}.
Nach dem Fest im Dorf {T} fuhr er zur Insel {T}.
Das Tal bei der Siedlung {T} gehört zur Stadt {T}.
Frau {name} erreichen Sie unter {phone}.
Das Zimmer in der {addr} ist frei.
Der Ausweis Nr. {id} liegt hier.
Herr {name} ist heute nicht da.
""",
    "fr": """
Chère {name}, merci de votre lettre.
Je m’appelle {name} et j’habite au {addr}.
Cordialement, {name}
Le tableau fut peint par {name} en {Y}.
Ce roman de {name} a paru en {Y}.
Demandez {name} à l’accueil.
Tél. : {phone}
Téléphone : {phone}
Appelez {name} au {phone}.
Courriel : {email}
Écrivez à {email} pour réserver.
Envoyez le colis à {name}, {addr}.
Adresse : {addr}
Son numéro de sécurité sociale est {id}.
Passeport n° {id} au nom de {name}.
Carte d’identité {id}, délivrée à {T}.
{T} a battu {T} de {N} points.
M. {S} et Mme {S} arrivent de {T}.
{E} a ouvert une usine près de {T} en {Y}.
La rue de {T} mène à la place de {T}.
Le numéro de série est {B}.
Numéro d’inventaire {N}31/{N}84, acquis en {Y}.
ISBN 978-2-{N}135-{N}81-2, édition {V}.
Environ {N},{N} % des membres de {E} ont voté.
Le pont fut construit par {E} en {Y}.
« Où est le train ? » demanda un chauffeur de {T}.
La fiche de {name} indique le numéro de sécurité sociale {id}.
Le contrat de {name} mentionne le passeport {id}.
La maison fut dessinée par {name} en {Y}.
La lettre fut signée par {name} et {name}.
Pour le bal, écrivez à {name} : {email}.
Téléphone de la mairie de {T} : {phone}.
Lettres : {name}, {addr}.
Merci d’écrire à {name}, {addr}, avant mardi.
{E} se situe à {N},{N} km de {T}.
En mars {Y}, le théâtre de {T} fut vendu à {E}.
Le prix a monté de {N},{N} %, p. ex. à {T} (cf. p. {N}).
Prévenez {name} au {phone}.
Le bureau se trouve au {addr}.
Madame {name} est absente.
""",
    "es": """
Estimada {name}: gracias por su carta.
Me llamo {name} y vivo en {addr}.
Atentamente, {name}
El cuadro fue pintado por {name} en {Y}.
La novela de {name} salió en {Y}.
Pregunte por {name} en la entrada.
Tel.: {phone}
Teléfono: {phone}
Llame a {name} al {phone}.
Correo: {email}
Escriba a {email} para reservar.
Envíe el paquete a {name}, {addr}.
Dirección: {addr}
Su DNI es {id} y caduca en {Y}.
Pasaporte n.º {id} a nombre de {name}.
El NIE {id} pertenece a {name}.
{T} venció a {T} por {N} puntos.
El Sr. {S} y la Sra. {S} llegaron de {T}.
{E} abrió una fábrica cerca de {T} en {Y}.
La calle {T} lleva a la plaza de {T}.
El número de serie es {B}.
Número de inventario {N}31-{N}-562, adquirido en {Y}.
ISBN 978-84-{N}135-{N}81-2, edición {V}.
Cerca del {N},{N} por ciento de los socios de {E} votó.
El puente fue construido por {E} en {Y}.
«¿Dónde está el tren?», preguntó un chófer de {T}.
La ficha de {name} indica el DNI {id}.
El contrato de {name} cita el pasaporte {id}.
La casa fue diseñada por {name} en {Y}.
La carta fue firmada por {name} y {name}.
Para el baile, escriba a {name} a {email}.
Teléfono del ayuntamiento de {T}: {phone}.
Cartas: {name}, {addr}.
{E} queda a {N},{N} km de {T}.
En marzo de {Y} el teatro de {T} pasó a {E}.
El precio subió un {N},{N} por ciento, p. ej. en {T} (pág. {N}).
La señora {name} no está.
Tengo un piso en la {addr} desde {Y}.
Avise a {name}.
""",
    "ru": """
Уважаемая {name}, спасибо за письмо.
Меня зовут {name}, я живу по адресу: {addr}.
С уважением, {name}
Картину написал художник {name} в {Y} году.
Автор книги — {name}.
Спросите {name} у входа.
Тел.: {phone}
Телефон: {phone}
Позвоните по номеру {phone}.
Почта: {email}
Пишите на {email}, чтобы заказать билет.
Отправьте посылку на имя {name}: {addr}.
Адрес: {addr}
Паспорт {id} выдан в {Y} году.
Паспорт на имя {name}: {id}.
{T} обыграл {T} на {N} очков.
Д-р {S} и проф. {S} приехали из города {T}.
{E} открыла завод близ города {T} в {Y} г.
Улица {T} ведёт к вокзалу.
Серийный номер {B} указан на корпусе.
Инвентарный номер {N}31/{N}84, куплено в {Y} году.
Версия {V} вышла {N} мая {Y} г.
Около {N},{N} % членов {E} голосовали за.
Мост был построен рабочими {E} в {Y} году.
«Где поезд?» — спросил водитель из села {T}.
В анкете записана {name}, паспорт {id}.
В договоре назван {name}, паспорт {id}.
Дом построил мастер по имени {name}.
Письмо подписали {name} и {name}.
По поводу билетов пишите {name} на {email}.
Телефон школы в городе {T}: {phone}.
Посылки для {name}: {addr}.
{T} лежит в {N},{N} км от города {T}.
В {Y} г. театр города {T} перешёл к {E}, т. е. раньше срока.
Цена выросла на {N} % и т. д.
Звоните: {name}, {phone}.
Наша контора: {addr}.
Сегодня {name} не работает.
""",
    "zh": """
电话：{phone}
请拨打{phone}预约。
如有疑问请致电{phone}。
邮箱：{email}
请将简历发至{email}。
他的身份证号是{id}。
身份证号码：{id}
护照号码{id}已过期。
{C}队以{N}比{N}战胜{C}队。
{E}于{Y}年在{C}开设新厂。
序列号为{B}。
编号{N}31/{N}84的藏品购于{Y}年。
馆藏编号{N}903-{N}7-568。
软件版本{V}已发布。
约有{N}.{N}%的会员来自{C}。
从{C}到{C}的距离为{D}公里。
{C}办公室的电话为{phone}。
表格上写的身份证号是{id}，护照号为{id}。
关于门票的问题请写信到{email}。
{C}的图书馆位于{E}。
价格上涨了{N}.{N}%（见第{N}页）。
这幅画的馆藏编号为INV {B}。
这本书的编号为{N}31/{N}84。
""",
    "ja": """
電話：{phone}
ご予約は{phone}までお電話ください。
連絡先は{phone}です。
メール：{email}
履歴書は{email}へお送りください。
旅券番号は{id}です。
マイナンバー：{id}
パスポート番号{id}は失効した。
{K}は{K}に{N}対{N}で勝った。
{E}は{Y}年に{K}で工場を開いた。
製造番号は{B}です。
所蔵番号{N}31/{N}84の絵は{Y}年に購入された。
所蔵番号{N}043-{N}0-977。
版{V}が公開された。
会員の約{N}.{N}％が{K}から来た。
{K}から{K}まで{D}キロある。
{K}事務所の電話番号は{phone}である。
用紙に書かれた旅券番号は{id}であった。
切符については{email}まで。
{K}の図書館は{E}にある。
価格は{N}.{N}％上がった（{N}頁）。
絵の所蔵番号は{N}31/{N}84である。
棚の所蔵番号はINV {B}である。
机の所蔵番号は{N}903-{N}7-568である。
本の番号は{B}です。
""",
}

_SYL = "tra ska wei plo fri nou gei dre ba ko shi mu thae vou zi rou kle jo hia gae ste lou pei fa gri".split()
_RU = "жу бра ле го сто ка ври дор та шесо мо пола три нуха".split()


class Filler:
    """Spellings for the slots, from a seeded generator and lists of name words."""

    def __init__(self, given: list[str], family: list[str], given_ru: list[str], family_ru: list[str], seed: int = 7):
        self.r = random.Random(seed)
        self.given, self.family, self.given_ru, self.family_ru = given, family, given_ru, family_ru

    def word(self, ru: bool = False) -> str:
        return "".join(self.r.choice(_RU if ru else _SYL) for _ in range(self.r.choice((2, 2, 3)))).capitalize()

    def number(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def name(self, lang: str) -> str:
        r = self.r
        if lang == "ru":
            # an incomplete lexicon: a fifth of the words are ones it lacks
            g = r.choice(self.given_ru) if r.random() < 0.8 else self.word(True) + "ля"
            f = r.choice(self.family_ru) if r.random() < 0.8 else self.word(True) + r.choice(("ов", "ский", "енко"))
            return r.choice((f"{f} {g}", f"{g} {f}", f"{g[0]}. {f}", f"{f} {g}", f"{g[0]}. {f}"))
        g = r.choice(self.given) if r.random() < 0.75 else self.word() + r.choice(("dan", "ren", "lis", "mi"))
        f = r.choice(self.family) if r.random() < 0.75 else self.word() + r.choice(("son", "mann", "by", "nez", "lard", "ford"))
        if r.random() < 0.15:
            f = f"{f}-{r.choice(self.family)}"
        k = r.random()
        if k < 0.45:
            return f"{g} {f}"
        if k < 0.58:
            return f"{g} {self.word()[0]}. {f}"
        if k < 0.7:
            return f"{g} {r.choice(('von', 'de', 'van'))} {f}"
        if k < 0.8:
            return f"{g[0]}. {f}"
        if k < 0.9:
            return f"{f}, {g}"
        return f"{g} {f}".upper() if k < 0.97 else f"{g} {f}".lower()

    def email(self) -> str:
        r = self.r
        a, b = self.word().lower(), self.word().lower()
        user = r.choice((f"{a}.{b}", f"{a}_{b}", f"{a}{self.number(2)}", f"{a[0]}{b}", f"office.{b}", f"{a}+{b}", f"{b}-{a}"))
        host = r.choice((self.word().lower(), f"{self.word().lower()}-{self.word().lower()}")) + r.choice((".example", ".test", ".invalid", ".co.example", ".edu.test", ".museum.example", ".org"))
        at = r.choice(("@",) * 6 + (" @ ", "＠", " [at] ", " AT ", "(at)", " (at) "))
        if at.strip() in ("[at]", "AT", "(at)"):
            host = host.replace(".", {"[at]": " [dot] ", "AT": " DOT ", "(at)": r.choice((".", " (dot) "))}[at.strip()])
            if at == " AT " or r.random() < 0.3:
                user = user.replace(".", {"AT": " DOT ", "[at]": " [dot] "}.get(at.strip(), "."))
        out = user + at + host
        return out.upper() if r.random() < 0.1 and at == "@" else out.title() if r.random() < 0.05 and at == "@" else out

    def phone(self, lang: str) -> str:
        r, n = self.r, self.number
        forms = {
            "en": (f"+1 202 555 {n(4)}", f"202-555-{n(4)}", f"(202) 555-{n(4)}", f"202.555.{n(4)}", f"202 555 {n(4)}", f"1-202-555-{n(4)} ext. {n(3)}", f"+1.202.555.{n(4)}", f"020 7946 {n(4)}", f"+44 20 7946 {n(4)}", f"+44 (0)20 7946 {n(4)}"),
            "de": (f"030 {n(5)} {n(3)}", f"030/{n(8)}", f"+49 30 {n(5)} {n(3)}", f"+49 (0)30 / {n(5)}-{n(3)}", f"0049 30 {n(8)}"),
            "fr": (f"01 99 00 {n(2)} {n(2)}", f"+33 1 99 00 {n(2)} {n(2)}", f"+33 (0)1 99 00 {n(2)} {n(2)}", f"01.99.00.{n(2)}.{n(2)}", f"01-99-00-{n(2)}-{n(2)}"),
            "es": (f"809-555-{n(4)}", f"809 555 {n(4)}", f"(809) 555 {n(2)} {n(2)}", f"+1 809-555-{n(4)}", f"+34 91 555 {n(4)}"),
            "ru": (f"+7 (495) {n(3)}-{n(2)}-{n(2)}", f"8 495 {n(3)} {n(2)} {n(2)}", f"8(495){n(7)}", f"8 (495) {n(3)}-{n(2)}-{n(2)}"),
            "zh": (f"010-{n(8)}", f"(010) {n(4)} {n(4)}", f"+86 10 {n(4)} {n(4)}", f"010 {n(8)}"),
            "ja": (f"03-{n(4)}-{n(4)}", f"（03）{n(4)}-{n(4)}", f"+81 3 {n(4)} {n(4)}", f"03 {n(4)} {n(4)}"),
        }
        return r.choice(forms[lang])

    def id(self, lang: str) -> str:
        r, n = self.r, self.number
        up = lambda k: "".join(r.choice("ABCDGHKLNQRTVXYZ") for _ in range(k))
        forms = {
            "en": (f"QQ {n(2)} {n(2)} {n(2)} C", f"QQ{n(6)}C", f"{up(2)}{n(7)}", f"{up(1)}{n(8)}", f"000 {n(2)} {n(4)}", f"9{n(2)}-{n(2)}-{n(4)}"),
            "de": (f"{n(2)} {n(3)} {n(3)} {n(3)}", n(11), f"{up(1)}{n(2)}{up(2)}{n(4)}", f"{up(1)}{n(2)}{up(2)}{n(3)}"),
            "fr": (f"{n(1)} {n(2)} 13 99 {n(3)} {n(3)} {n(2)}", n(15), f"{n(2)}{up(2)}{n(5)}"),
            "es": (f"00.{n(3)}.{n(3)}-{up(1)}", f"{n(8)}{up(1)}", f"X-{n(7)}-{up(1)}", f"X{n(7)}{up(1)}", f"{n(8)}-{up(1)}"),
            "ru": (f"00 {n(2)} {n(6)}", f"00{n(2)} № {n(6)}", f"00{n(2)} {n(6)}"),
            "zh": (n(18), n(17) + "X", f"{up(1)}{n(8)}"),
            "ja": (f"{up(2)}{n(7)}", n(12)),
        }
        return r.choice(forms[lang])

    def addr(self, lang: str) -> str:
        r, n = self.r, str(self.r.randint(1, 299))
        t, s = self.word(), self.word(lang == "ru")
        if lang == "en":
            street = f"{n} {s} {r.choice(('Street', 'St.', 'Road', 'Rd', 'Avenue', 'Ave.', 'Lane', 'Hill', 'Court', 'Terrace'))}"
            return r.choice((street, street, f"{street}, Apt {r.randint(1, 40)}{r.choice('ABC')}", f"Flat {r.randint(1, 30)}, {street}, {t}", f"{street}, {t} {self.number(5)}", f"P.O. Box {self.number(4)}, {t}", f"P.O. Box {self.number(4)}, {t}", f"P.O. Box {self.number(3)}"))
        if lang == "de":
            h = n + r.choice(("", "", "a", "b", "c"))
            street = r.choice((f"{s}straße {h}", f"{s}weg {h}", f"{s}platz {h}", f"{s}gasse {h}", f"Am {s} {h}", f"{s}str. {h}"))
            return r.choice((street, f"{street}, {t}", f"{street}, {self.number(5)} {t}", f"Postfach {self.number(4)}, {t}"))
        if lang == "fr":
            h = n + r.choice(("", "", " bis", ","))
            way = f"{r.choice(('rue', 'avenue', 'place', 'impasse', 'quai', 'bd'))} {r.choice(('', 'de '))}{s}"
            street = f"{h}{',' if h.endswith('bis') else ''} {way}"
            return r.choice((street, f"{street}, {self.number(5)} {t}", f"BP {self.number(3)}, {self.number(5)} {t}"))
        if lang == "es":
            way = f"{r.choice(('calle', 'avenida', 'Avda.', 'C/', 'paseo', 'plaza'))} {r.choice(('', 'de '))}{s}"
            return r.choice((f"{way} {n}, {self.number(5)} {t}", f"{way} {n}", f"{way}, {n}", f"{way}, nº {n}, 2º B", f"Apartado {self.number(3)}, {self.number(5)} {t}"))
        t = self.word(True)
        way = f"{r.choice(('ул.', 'улица', 'пер.', 'просп.'))} {s}"
        return r.choice((f"{way}, дом {n}, кв. {r.randint(1, 99)}", f"{way}, д. {n}", f"{way}, дом {n}", f"г. {t}, {way}, {n}", f"г. {t}, {way}, {n}"))

    def other(self, slot: str, lang: str) -> str:
        r = self.r
        if slot == "T":
            return self.word(lang == "ru" and r.random() < 0.8)
        if slot == "S":
            return self.word(lang == "ru")
        if slot == "E":
            w = self.word()
            return r.choice((w, f"{w} {self.word()}", f"{w} Inc.", f"{w} F.C.", f"Port {w}", f"Lake {w}", f"St. {w}", f"University of {w}", f"{w} Suite No. {r.randint(1, 9)}", f"Baie de {w}", f"Ballade {w}", f"{w} Fields", f"{w} & {self.word()}", f"{w}-{self.word()} Union", "Orvélan Fiord", "泉平山", self.word(True), f"The Marble Seminar of {w}", f"Institut für {w}", f"Société {w}"))
        if slot == "Y":
            return str(r.randint(1640, 2019))
        if slot == "N":
            return str(r.randint(1, 99))
        if slot == "D":
            return f"{r.randint(1, 999)}.{self.number(r.choice((1, 2, 3)))}"
        if slot == "B":
            return f"{r.randint(1, 9)} {self.number(3)} {self.number(3)}" if r.random() < 0.5 else self.number(7)
        if slot == "V":
            return ".".join(str(r.randint(1, 99)) for _ in range(r.choice((3, 4))))
        if slot == "M":
            return r.choice("January February March April May June July August September October November December".split())
        if slot == "C":
            return "".join(r.choice("川平竹岭阳溪山宁南峰安林云江石兰柏") for _ in range(r.choice((2, 3, 4))))
        if slot == "K":
            return "".join(r.choice("イムサナミマバベアラドスダクカギコ") for _ in range(r.choice((3, 4, 5))))
        pool = "library bridge canal harbour museum theatre market lagoon quarry ferry archive census choir dam" if slot == "W" else "narrow old silver royal remote northern coastal flooded medieval public wooden late sold opened"
        return r.choice(pool.split())


def labelled_rows(filler: Filler, rounds: int = 12) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]): every sentence `rounds` times with other fillings, one to three sentences of a language together in pseudo-random
    order; at most rounds times the sentences."""
    rows = []
    for _ in range(rounds):
        for lang, block in SENTENCES.items():
            lines = block.strip().split("\n")
            filler.r.shuffle(lines)
            k = 0
            while k < len(lines):
                n = filler.r.choice((1, 1, 2, 3))
                text, spans = "", []
                for line in lines[k : k + n]:
                    if text:
                        text += "" if lang in ("zh", "ja") else filler.r.choice((" ", " ", "\n"))
                    more, found = filled(line, lang, filler)
                    spans += [(kind, len(text) + a, len(text) + b) for kind, a, b in found]
                    text += more
                rows.append((text, spans))
                k += n
    return rows


def filled(line: str, lang: str, filler: Filler) -> tuple[str, list[tuple[str, int, int]]]:
    """One sentence with its slots filled, and the places of those that are personal information."""
    kinds = {"name": "name", "email": "email", "phone": "phone", "id": "id_number", "addr": "address"}
    text, spans, rest = "", [], line
    while "{" in rest:
        before, _, rest = rest.partition("{")
        slot, _, rest = rest.partition("}")
        text += before
        if slot in kinds:
            value = filler.email() if slot == "email" else getattr(filler, slot)(lang)
            spans.append((kinds[slot], len(text), len(text) + len(value)))
        else:
            value = filler.other(slot, lang)
        text += value
        if value.endswith(".") and rest.startswith("."):
            rest = rest[1:]
    return text + rest, spans
