"""Made-up labelled rows for the recogniser of personal data: sentences in several languages with items put into their slots.

The wording, names, hosts and places are our own: notes of a community centre, a clinic's desk, a depot and a choir. No row, phrase or host of any table is used; a test checks
the fixed wording against the tables. What is no item (ordinary prose, institutions, works, events, codes, dates, sizes) comes from small grammars over everyday words.
"""

from __future__ import annotations

import random
import re

# Common first and family names, and parts of invented ones.
_FIRST = "Anna Peter Maria John Sofia David Emma Lucas Laura Thomas Julia Martin Clara Daniel Nina Felix Elena Pablo Ines Hugo Marta Oscar Lena Jonas Alice Victor Rosa Simon Irene Paul Helen Robert Judith Karl Amélie Léo Zoé Renée José Raúl Begoña João Inês Jürgen Käthe Søren Åsa Chloé François Núria Łukasz Omar Fatima Aisha Ravi Priya Wei Mei Kofi Amara".split()
_LAST = "Smith Jones Brown Taylor Wilson Evans Walker Harris Clarke Turner Müller Schmidt Weber Wagner Becker Schäfer Krüger Vogel Dubois Laurent Lefèvre Moreau Girard Fournier García López Martínez Sánchez Fernández Ruiz Núñez Silva Santos Ferreira Pereira Gonçalves Rossi Ferrari Novak Kowalski Nielsen Larsen O'Brien O'Neill D'Angelo MacLeod Nguyen Patel Singh Okafor Mensah Haddad".split()
_ON = "b bl br c ch d dr f fl g gr h j k kl l m n p pr qu r s sh sk sl st t th tr v w z".split()
_NUCLEUS = "a e i o u ae ai au ea ei eo ia ie oa oo ou".split()
_CODA = ["", "", "", "l", "n", "r", "s", "t", "k", "m", "x", "th", "ck", "ff", "ld", "lt", "nd", "ng", "rk", "rt", "ss"]
_ACCENT = dict(zip("aeiouncs", ("áàâãäå", "éèêë", "íìîï", "óòôõö", "úùûü", "ñ", "ç", "š"), strict=True))
_HAN_LAST = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 斎藤 清水 山崎 森 池田 橋本 阿部 石川 前田 藤田 小川 岡田 後藤 長谷川 村上 近藤 石井 坂本 遠藤 青木 藤井 西村 福田 太田 三浦 岡本 藤原 中島 松田 原田 金子 中野 竹内 上田 小野 田村 水野 安藤 白石 黒田 大塚 北川 川崎 桜井 星野 朝倉 海野 雨宮 月岡 神谷 羽田 若林 土屋 久保 野崎 滝沢 浅野 宮本 成瀬 柏木 早川 河合 平野".split()
_HAN_FIRST = "翔太 美咲 健一 陽菜 大輔 愛 直樹 結衣 拓也 桜 真由美 裕子 和也 千尋 達也 彩香 光 葵 蓮 悠斗 恵美 隆 明日香 慎吾 由紀 誠 香織 浩二 麻衣 哲也 優子 亮 凛 楓 湊 奏太 紗希 友美 正人 智子 一郎 花子 涼介 瑞希 美月 海斗 晴香 雄大 弥生 純 詩織 翼 実 静香 千夏 祥子 遥 朔 希 真人".split()
_KANA_LAST, _KANA_FIRST = "サトウ スズキ タナカ ワタナベ ヤマモト コバヤシ カトウ ヨシダ モリ ハヤシ スミス ミラー ガルシア イワノフ".split(), "ハナコ タロウ ユキ ケンタ ミサキ アキラ ジョン アンナ マリア ピーター サラ エマ".split()
_RU_FIRST, _RU_FEM = "Иван Пётр Алексей Дмитрий Сергей Михаил Николай Андрей Виктор Олег".split(), "Анна Мария Ольга Елена Наталья Ирина Светлана Татьяна Вера Юлия".split()
_RU_LAST = "Иванов Петров Смирнов Кузнецов Соколов Попов Лебедев Козлов Новиков Морозов Волков Соловьёв Васильев Зайцев Павлов Голубев".split()
_RU_PART, _RU_END = "бар вел гор дан жил зар кор лут мар нор рад сев тол хар яр бел дро кла стр".split(), "ов ев ин ский ич ко ук".split()
_HOSTS = "acorn bluepost cedarmail driftwood eastgate ferry garnet harvest ivory juniper lanternfish mailbox orchard pinecone riverbank sandstone".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def pick(self, x):
        return self.r.choice(x)

    def word(self) -> str:
        w = "".join(self.pick(_ON) + self.pick(_NUCLEUS) for _ in range(self.r.choice((0, 1, 1, 2)))) + self.pick(_ON) + self.pick(_NUCLEUS) + self.pick(_CODA)
        if len(w) < 3:
            w += self.pick(("na", "ro", "lin", "ser"))
        if self.r.random() < 0.2:
            w = "".join(self.pick(_ACCENT[c]) if c in _ACCENT and self.r.random() < 0.3 else c for c in w)
        w = w[0].upper() + w[1:]
        k = self.r.random()
        return w + "-" + self.pick(_FIRST) if k < 0.02 else self.pick(("O'", "D'", "Mc", "Van ", "de ")) + w if k < 0.04 else w

    def first(self) -> str:
        return self.pick(_FIRST) if self.r.random() < 0.3 else self.word()

    def last(self) -> str:
        return self.pick(_LAST) if self.r.random() < 0.3 else self.word()

    def russian(self) -> str:
        if self.r.random() < 0.5:
            made = (self.pick(_RU_PART) + self.pick(("", "а", "и", "о")) + self.pick(_RU_PART)).capitalize()
            last = made + self.pick(_RU_END)
        else:
            last = self.pick(_RU_LAST)
        if self.r.random() < 0.5:
            given = self.pick(_RU_FIRST) if self.r.random() < 0.5 else (self.pick(_RU_PART) + self.pick(("ан", "ир", "ей", "ил"))).capitalize()
        else:
            given = self.pick(_RU_FEM) if self.r.random() < 0.5 else (self.pick(_RU_PART) + self.pick(("ана", "ира", "ия", "ель"))).capitalize()
            last += "а" if last[-2:] in ("ов", "ев", "ин", "ёв") else ""
        return f"{given} {last}" if self.r.random() < 0.7 else f"{last} {given}" if self.r.random() < 0.5 else given

    def han(self) -> str:
        last = self.pick(_HAN_LAST) if self.r.random() < 0.5 else self.pick(_HAN_LAST)[0] + self.pick(_HAN_LAST)[-1]
        first = self.pick(_HAN_FIRST) if self.r.random() < 0.5 else self.pick(_HAN_FIRST)[0] + self.pick(_HAN_FIRST)[-1]
        k = self.r.random()
        return last if k < 0.12 else last + self.pick(("", "", " ", "　")) + first

    def name(self) -> str:
        k = self.r.random()
        if k < 0.45:
            return self.latin()
        if k < 0.75:
            return self.han()
        if k < 0.85:
            return self.pick(_KANA_LAST) + self.pick((" ", "　", "・")) + self.pick(_KANA_FIRST) if self.r.random() < 0.4 else "".join(self.pick("アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワガギグゲゴザジズダデドバビブベボ") for _ in range(self.r.randint(2, 4))) + self.pick((" ", "　")) + "".join(self.pick("アイウエオカキクケコサシスセソタチツテトナニネノハヒフマミムメモヤユヨラリルレロ") for _ in range(self.r.randint(2, 3)))
        return self.russian()

    def latin(self) -> str:
        k = self.r.random()
        n = f"{self.first()} {self.last()}" if k < 0.62 else self.first() if k < 0.8 else self.last() if k < 0.92 else f"{self.first()} {self.last()} {self.last()}" if k < 0.96 else f"{self.first()[0]}. {self.last()}"
        k = self.r.random()
        return n.lower() if k < 0.04 else n.upper() if k < 0.09 else n

    def digits(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def wide(self, x: str) -> str:
        return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else "　" if c == " " else c for c in x) if self.r.random() < 0.07 else x

    def phone(self) -> str:
        """Numbers as they are written in a dozen countries: trunk or country code and groups."""
        d, k, sep = self.digits, self.r.random(), self.pick((" ", "-", ".", " "))
        if k < 0.25:  # North America
            a, b, c = self.pick("2345679") + d(2), self.pick("23456789") + d(2), d(4)
            x = self.pick((f"+1{sep}{a}{sep}{b}{sep}{c}", f"({a}) {b}-{c}", f"{a}{sep}{b}{sep}{c}", f"+1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}"))
        elif k < 0.45:  # mobile numbers with a trunk zero
            x = self.pick((f"07{d(3)} {d(3)} {d(3)}", f"07{d(3)} {d(6)}", f"07{d(9)}", f"090-{d(4)}-{d(4)}", f"080-{d(4)}-{d(4)}", f"070{d(8)}", f"06 {d(2)} {d(2)} {d(2)} {d(2)}", f"06{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}", f"0{self.pick('15')}{d(2)} {d(7)}", f"01{d(2)}/{d(7)}"))
        elif k < 0.7:  # with a country code
            cc = self.pick(("44 20", "44 7" + d(3), "49 30", "49 1" + d(2), "33 1", "33 6", "34 6" + d(2), "34 9" + d(2), "81 3", "81 90", "351 9" + d(2), "7 9" + d(2), "7 495", "39 06", "41 44", "43 1", "31 20"))
            rest = self.pick(([4, 4], [3, 4], [3, 3], [2, 2, 2, 2], [6], [7], [5, 3], [3, 2, 2]))
            x = f"+{cc}{sep}" + sep.join(d(n) for n in rest)
            x = x.replace("+", "00", 1) if self.r.random() < 0.1 else x
        else:  # landlines with a trunk zero
            x = self.pick((f"0{d(1)}-{d(4)}-{d(4)}", f"0{d(2)}-{d(3)}-{d(4)}", f"0{d(3)} {d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)}/{d(6)}", f"0{d(3)}-{d(6)}", f"9{d(2)} {d(3)} {d(3)}", f"8 (9{d(2)}) {d(3)}-{d(2)}-{d(2)}", f"2{d(2)} {d(3)} {d(3)}"))
        return self.wide(x)

    def id_number(self) -> str:
        """Numbers that states give to persons: social security, personal and tax numbers, insurance numbers, identity cards, passports."""
        d, a = self.digits, lambda n: "".join(self.pick("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
        return self.wide(self.pick((f"{d(3)}-{d(2)}-{d(4)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", d(12), f"{a(2)} {d(2)} {d(2)} {d(2)} {a(1)}", f"{a(2)}{d(6)}{a(1)}", f"{a(2)}{d(7)}", f"{a(1)}{d(8)}", f"{a(1)}{d(7)}", f"{d(8)}{a(1)}", f"{d(8)}-{a(1)}", f"{self.pick('XYZ')}{d(7)}{a(1)}")))

    def email(self) -> str:
        user = self.pick(("{0}.{1}", "{0}_{1}", "{0}{1}", "{0}+post", "{0}.{1}{2}", "{0}", "{0}-{1}", "{0}{2}")).format(self.first().lower(), self.last().lower(), self.digits(2))
        user = re.sub(r"[^a-z0-9._+-]", "", user) or "desk"
        host = self.pick(_HOSTS) if self.r.random() < 0.6 else self.pick(("mail", "post", "mx", "web")) + "." + self.pick(_HOSTS)
        tld = self.pick(("example", "test", "invalid", "com", "org", "net", "de", "fr", "co.uk"))
        k = self.r.random()
        at, dot = (self.pick(((" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" [at] ", "."), ("(at)", "."), (" <at> ", "."), (" AT ", " DOT "), (" {at} ", " {dot} "), (" (arroba) ", " (punto) ")))) if k > 0.75 else ("@", ".")
        e = f"{user}{at}{(host + '.' + tld).replace('.', dot)}"
        return self.wide(e.upper() if self.r.random() < 0.05 else e)

    def street(self) -> str:
        w, n = self.word(), self.r.randint(1, 300)
        s = self.pick(("Street", "St.", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Close", "Row", "Drive", "Court", "Place", "Square", "Terrace", "Way"))
        town = self.pick(("", "", f", {self.word()}"))
        lead = self.pick(("", "", "", "Upper ", "Lower ", "North ", "Old ", "New "))
        flat = self.pick(("", "", f", Apt {self.r.randint(1, 40)}", f", Flat {self.r.randint(1, 40)}", f" Unit {self.r.randint(1, 40)}"))
        han = self.pick(_HAN_LAST)[0] + self.pick("川原田野島山浜崎")
        return self.pick(
            (
                f"{n} {lead}{w} {s}{town}", f"{n}{self.pick('ABC')} {lead}{w} {s}{town}", f"{n} {lead}{w} {s}{flat}", f"{lead}{w} {s} {n}{flat}", f"{w}'s {s} {n}", f"{w}stra{self.pick(('ß', 'ss'))}e {n}", f"{w}str. {n}", f"{w}{self.pick(('weg', 'gasse', 'platz', 'allee', 'ring', 'damm'))} {n}", f"{w}straße {n}, {self.digits(5)} {self.word()}",
                f"{n} {self.pick(('rue', 'avenue', 'boulevard', 'chemin', 'place'))} {self.pick(('', 'de ', 'du ', 'des ', 'de la '))}{w}", f"{n} bis, rue {w}-{self.pick(_LAST)}", f"{n}, rue de {w}, {self.digits(5)} {self.word()}", f"calle {w} {n}", f"calle de {w}, {n}, {self.r.randint(1, 9)}º {self.pick('ABCD')}", f"Avenida {w} {n}", f"plaza {w} {n}", f"Rua {w} {n}", f"rua da {w}, {n}", f"Travessa {w} {n}",
                f"P.O. Box {n}", f"PO Box {self.digits(4)}, {w}", f"Postfach {self.digits(4)}", f"BP {n}", f"apartado {n}", f"Caixa postal {n}", f"私書箱{n}", f"а/я {n}", f"ул. {self.pick(_RU_PART).capitalize()}{self.pick(_RU_PART)}{self.pick(('ская', 'ова', 'ная'))}, д. {n}", f"улица {self.pick(_RU_PART).capitalize()}{self.pick(_RU_PART)}ная, {n}", f"проспект {self.pick(_RU_PART).capitalize()}{self.pick(_RU_PART)}а {n}",
                f"{self.pick(('長野', '静岡', '群馬', '香川', han))}県{han}市{self.pick(('本町', '栄町', '緑が丘', '桜台', '東', '中央'))}{self.r.randint(1, 9)}-{self.r.randint(1, 30)}-{self.r.randint(1, 20)}", f"{han}市{self.pick(('旭町', '南台', '新町'))}{self.r.randint(1, 9)}丁目{self.r.randint(1, 30)}番地", f"〒{self.digits(3)}-{self.digits(4)} {han}県{han}市{self.pick(('本町', '西'))}{self.r.randint(1, 9)}-{self.r.randint(1, 30)}",
            ))

    def slot(self, kind: str) -> str:
        return {"N": self.name, "L": self.latin, "H": self.han, "R": self.russian, "P": self.phone, "I": self.id_number, "E": self.email, "S": self.street}[kind]()


_KIND = {"N": "name", "L": "name", "H": "name", "R": "name", "P": "phone", "I": "id_number", "E": "email", "S": "street_address"}


def _items(text: str) -> list[str]:
    return text.strip().replace("\n", "|").split("|")


# Sentences with items, one list a language.
WITH_ITEMS = _items("""
Mr {L} has the van keys|Mrs {L} cancelled her slot|Ms {L} paid in cash|Miss {L} plays the organ|Dr {L} is on call|Prof. {L} gives the talk|Coach {L} locked up|Nurse {L} took the sample|{L} carries the drum|{L} and {L} share a boat|{L}, {L} and {L} row together|seat kept for {L}|gift from {L}|parcel left by {L}|{L} owes two euros|{L} swaps shifts|drove home with {L}|met {L} at the pier|asked {L} about the roof
our neighbour {L} found it|her grandfather, {L}, built the shed|his sister ({L}) waters the plants|the carpenter, {L}, measured twice|approved: {L}|checked by {L}|driver: {L}|caller: {L}|Witness: {L}, depot|quoted {L} on this|{L}'s umbrella is here|{L}’s badge expired|keys are with {L}|spoken for by {L}|In reply to {L}: yes|Thank you, {L}|Dear {L}|Hello {L}|Regards, {L}|note for {L}|told {L} and the crew|next to {L} on the bench|behind {L} in the queue|trains under {L}|{L} drops out|{L} will sing alto|per {L}: postpone
{L} (deputy) opens the hall|as agreed with {L}|friend of {L}|nephew of {L}|room booked for {L}|ask for {L} at reception|{L} knows the code|helped {L} with boxes|invite {L} too|{L} was on duty|without {L} no rehearsal|thinks like {L}|rides with {L} on Sundays|cc: {L}|owner {L}|{L} {I}|{L}, {P}|{L}: {E}
Herr {L} bringt die Leiter|Frau {L} sucht den Schirm|Herrn {L} gefragt|mit {L} im Lager|von {L} ausgeliehen|für {L} hinterlegt|{L} fehlt heute|{L} holt das Paket|{L} singt Tenor|Nachbarin {L} gießt die Blumen|ihr Onkel, {L}, fährt|laut {L} erledigt|bei {L} abgegeben|Schlüssel hat {L}|Grüße an {L}|Fahrerin: {L}|sein Bruder {L} kommt
Mme {L} garde la clé|M. {L} répare la porte|Madame {L} est passée|avec {L} au marché|chez {L} ce soir|pour {L} à la réception|{L} chante juste|{L} prend le relais|d'après {L}, rien|son voisin, {L}, attend|sa sœur {L} conduit|vu avec {L}|prêté par {L}|merci à {L}|Bonjour {L}
Sr. {L} abre la puerta|la Sra. {L} tiene frío|con {L} en el taller|para {L} en caja|{L} trae el pan|{L} canta bien|su vecina, {L}, espera|su tío {L} conduce|según {L}, mañana|prestado por {L}|gracias a {L}|Hola {L}|junto a {L} en la fila|hermana de {L}|o senhor {L} chegou|a vizinha, {L}, espera|com {L} no barco|{L} traz o pão|segundo {L}, amanhã|obrigado a {L}|irmã de {L}
{R} принёс ключи|{R} принесла хлеб|Ждём {R}|с братом {R} в лодке|тётя ({R}) звонила|сосед: {R}|Водитель {R}|вместе с {R} поют|{R} уехал|{R} болеет|передать: {R}|г-н {R} согласен|Спасибо, {R}
{H}さんが到着。|{H}様宛ての荷物。|担当：{H}|{H}氏に依頼。|{H}君が休み。|{H}くんと散歩。|{H}ちゃんの傘。|{H}先生の診察。|祖父（{H}）が運転。|隣の{H}さんに鍵を渡す。|{H}と一緒に歌う。|{H}へ電話。|運転手は{H}。|叔母の{H}様が待つ。|{H}殿|{H}が到着した。|{H}に聞く。|兄（{H}）と帰る。|{N}さんから届いた。|{N}様に渡す。|受取人 {N}|記入者：{N}|{N}さま、ありがとう|{H}選手が優勝。|{H}の靴を発見。|{H}は欠席。|{H}も参加。
{N} <{E}>|{N} <{E}>|{N} ({E})|{N}, {E}|{E}|{E}|{E}|{E}, {E}|{E}; {E}|{E} / {P}|{E}; {P}|{E} or {P}|{N} {E}|mailto:{E}|E-mail: {E}|mail {E} first|reach us via {E}|forwarded to {E}|from {E} at noon|invoice goes to {E}|({E})|<{E}>|Mail: {E}|courriel : {E}|Mail an {E}|correo: {E}|почта {E}|メール {E}|宛先：{E}|use {E} instead|{E} is full|send photos to {E}, thanks
phone {P}|Tel. {P}|tel: {P}|dial {P} for the gate|mobile {P}|cell {P}|text {P} when here|{P}|{P} after six|fax: {P}|WhatsApp {P}|Ruf {P}|Handy: {P}|mobil {P}|tél : {P}|portable {P}|tfno. {P}|móvil {P}|telemóvel {P}|тел.: {P}|звонить {P}|電話：{P}|携帯{P}|連絡は{P}まで|reachable on {P}|{N} {P}|{N}: {P}|{P} or {P}|home {P}, work {P}|number: {P}|her number is {P}
SSN: {I}|social security {I}|passport no. {I}|passport {I} expires soon|Passport: {I}|national id {I}|insurance no. {I}|NINO: {I}|tax number {I}|personal number {I}|ID card {I} copied|Personalausweis {I}|Reisepass {I}|Steuernummer {I}|carte d'identité n° {I}|passeport {I}|numéro fiscal {I}|DNI: {I}|NIE {I}|pasaporte {I}|NIF {I}|passaporte {I}|паспорт: {I}|ИНН {I}|個人番号 {I}|マイナンバー：{I}|旅券番号 {I}|{I}|identity {I} verified|holder of {I}|showed {I} at the gate
lives at {S}|now at {S}|deliver to {S}|pick up: {S}|address: {S}|Address {S}|flat in {S}|{S}|meet outside {S}|Adresse: {S}|wohnt in der {S}|zieht um: {S}|adresse : {S}|habite au {S}|domicile {S}|dirección: {S}|vive en {S}|morada: {S}|mora em {S}|адрес: {S}|живёт: {S}|住所：{S}|送り先 {S}|return to sender, {S}|office: {S}|van parked by {S}|post goes to {S}|{N}, {S}|{N} / {S}|{N} ({P})|{N} / {E}|{N} ({S})|{N} <{P}>|{N} ({I})|{N} / {I}|{N} <{I}>|{N}; {I}|{I} {N}|{N} - {P}|{N} / {P}|{N} - {S}|{N} <{S}>|{N} {S}|{N} [{I}]|{N}, {I}|{I}; {P}|{I} / {E}|{N}; {P}|{N}|{N}|{L}|{N} (3)
""")

# Everyday words of the grammars, one line a language: how a sentence starts; things; how it ends.
_EVERYDAY = {
    "en": (
        "Needs|Asked for|Brought|Forgot|Keeps|Lost|Found|Wants|Likes|Shows|Finished|Missed|Returned|Checks|Draws|Reads|Writes|Explains|Repeats|Prefers|Practises|Improved|Toils at|Works on|Talks about|Waits for|Was late for|Is good at|Has trouble with|Please bring|Please return|Do not forget|Remember|No news on|Nothing about|Still no|Very happy with|Great|Good|Poor|Weak|Steady|Better|More|Less|Excellent|Careful with|Prepare|Bring|Collect|Order|Repair|Paint|Book|Cancel|Move|Open|Close|Test|Count|Copy|Print|needs|asked for|keeps|wants|likes|shows|missed|returned|reads|explains|improved in|weak in|strong in|quiet during|loud during|helps with|tired of|behind in|ahead in",
        "the blue folder|a new timetable|warm clothes|garden tools|the spare key|fractions|spelling|singing|geometry|the second half|the choir|a longer break|extra sheets|the big drum|the boiler|reading aloud|the summer fair|two chairs|a quiet corner|the heating|grammar|history|chess|the pump|music|the printer|tables|the roof|drawing|science|the poster|vocabulary|old maps|the piano|group work|the kitchen|swimming|maths|the lamp|deadlines",
        "after lunch|next week|since autumn|again|on time|with care|in the hall|today|before noon|for now|this year|at home|most days|by Friday|on Monday|in March|in winter|every Tuesday|",
    ),
    "de": (
        "Bringt|Sucht|Vergisst|Liest|Zeigt|Braucht|Übt|Hört|Repariert|Bestellt|Malt|Wartet auf|Redet über|Fragt nach|Gute|Schwache|Bessere|Keine|Neue|Bitte|Heute|Morgen|Gestern|Oft|Selten|Ständig|Ohne|Nach|Vor|Während|Für|Über|Außer|Mehr|Weniger|Viel|Etwas|Ärger mit|Öfter|Äußert|Lernt|Kann|Soll|Muss|Will|Hilft bei|Freut sich auf",
        "den Schlüssel|die Leiter|das Werkzeug|neue Schuhe|den Kuchen|die Pumpe|der Heizung|dem Chor|die Bühne|Brüche|Wörter|die Pause|das Lager|den Garten|die Küche|Noten|die Lampe|das Heft|Regen|Musik|die Tür|Ordnung|den Plan|Geduld|Mathe|Lesen|Physik|die Karte|das Sommerfest|den Bus|Kunst|Technik",
        "am Abend|im Garten|seit Montag|im Herbst|heute|morgen|zu spät|sehr gern|ohne Mühe|nach der Pause|im Mai|jede Woche|wieder|schnell|",
    ),
    "fr": (
        "Cherche|Attend|Apporte|Oublie|Lit|Montre|Répare|Écoute|Étudie|À revoir|Très|Bon|Bonne|Faible|Mieux|Encore|Toujours|Jamais|Souvent|Où|Pourquoi|Après|Avant|Pendant|Sans|Avec|Pour|Beaucoup de|Peu de|Trop de|Aucun|Nouveau|Nouvelle|Être à|Ânonne|Île et|Doit revoir|Peut mieux faire en|Aime|Déteste|Progresse en|Parle de|Rend",
        "le dossier bleu|la clé|les outils|la lampe|le chauffage|la chorale|les fractions|l'orthographe|la grammaire|le jardin|la cuisine|musique|dessin|calcul|lecture|le goûter|la fête|l'affiche|les billets|le bus|le ménage|la pause|l'exercice|sciences|géométrie|histoire|le toit|la pluie",
        "ce soir|demain|depuis lundi|en automne|à la maison|sans effort|trop tard|chaque semaine|en mai|à midi|encore|",
    ),
    "es": (
        "Busca|Trae|Olvida|Lee|Muestra|Repara|Escucha|Estudia|Muy|Buen|Buena|Poca|Mejor|Peor|Siempre|Nunca|¿Dónde está|¿Cuándo llega|¿Falta|¡Atención con|Después de|Antes de|Durante|Sin|Con|Para|Más|Menos|Nueva|Nuevo|Último|Única|Ánimo con|Él prefiere|Habla de|Necesita|Quiere|Ayuda en|Procura|Traz|Esquece|Precisa de|Gosta de|Fala de|Não tem|Ótima|Às vezes|Último|É bom em|Está sem|Além de",
        "la llave|las herramientas|la lámpara|el coro|las fracciones|la lectura|la cocina|el jardín|música|dibujo|cálculo|la fiesta|el cartel|los billetes|el autobús|la pausa|ciencias|historia|la lluvia|el tejado|a chave|as contas|o coro|a leitura|a cozinha|o jardim|desenho|cálculo|a festa|o bilhete|a pausa|o telhado|gramática|paciencia|orden",
        "esta tarde|mañana|desde el lunes|en otoño|en casa|sin esfuerzo|tarde|cada semana|en mayo|otra vez|amanhã|em casa|cedo|no outono|",
    ),
    "ru": (
        "Ищет|Приносит|Забыл|Читает|Пишет|Считает|Нужны|Нет|Есть|Хорошо|Плохо|Очень|Часто|Редко|Всегда|После|Перед|Без|Для|Новый|Новая|Старая|Много|Мало|Лучше|Хуже|Нужен|Ждёт|Любит|Рисует|Поёт|Починить|Купить|Проверить|Снова|Завтра|Вчера|Сегодня|Ошибки в|Успехи в|Готов к|Опять",
        "ключи|инструменты|лампу|хор|дроби|чтение|кухню|сад|музыку|рисунок|праздник|плакат|билеты|автобус|перерыв|науку|историю|дождь|крышу|письмо|слова|порядок|терпение|физику|книгу|карту|стихи|счёт|обед",
        "вечером|завтра|с понедельника|осенью|дома|без труда|поздно|каждую неделю|в мае|снова|в зале|",
    ),
}
_HAN_WORDS = "会議 資料 予約 来週 午後 荷物 倉庫 受付 返品 天気 駅前 電車 朝食 野菜 図面 工事 庭園 合唱 会費 名簿 掃除 料理 音楽 散歩 旅行 写真 地図 時計 電池 毛布 薬局 診察 検査 歴史 理科 社会 作文 読書 体操 水泳 絵画 工作 辞書 図書館 体育館 練習帳 予定表 説明書 領収書 研究所 大学 高校 商店街 郵便局 市役所 美術館 放送 連絡網 班 今年 毎朝 夕方 春 夏休 秋 冬 東口 北側 二階 第一 全員 各自 本人 家族 友人 先月 再来週 途中 集中力 協力 努力 注意 反省 復習 予習 暗算 漢字 文法 単語 実験 観察 発音 朗読 討論 感想 目標 課題 提出物 忘物 遅刻 早退 健康 体調 風邪 視力".split()
_HAN_VERBS = "が届いた。|を確認した。|は中止。|が終わった。|は延期。|が必要。|を忘れた。|が良い。|を始める。|が苦手。|が得意。|は未定。|を続ける。|に参加。|の準備中。|が増えた。|を借りた。|が足りない。|に集中できた。|を見直す。|は順調。|がとても上手。".split("|")
_KANA_WORDS = "ノート プール バス チーム クラブ ピアノ パソコン ドア ランプ カレンダー ポスター スピーチ グループ ボール テント サイズ コピー レポート アンケート メモ".split()

# What has a capital letter, digits or an at sign and is no item.
WITHOUT = _items("""
visit the {W} Library|open day at {W} Primary School|{W} Academy plays at home|{W} College sends two teams|moved from {W} University|ferry to {W} Island|the {W} Festival sells out|ran the {W} Marathon|won silver at the {W} Trophy|nominated for the {W} Award|page {d2} of the {W} Dictionary|borrowed '{W} at Night'|watched "The {W} Garden"|reads “{W} and the Fox”|chapter {d1} of The {W} Mystery|matinee at the {W} Theatre|picnic by {W} Lake|storm over {W} Bay|bus stops in {W}|hall of {W} Church|exam of the {W} Board|{W} Press, second edition|{W} Secondary School cancelled|{W} Grammar School, hall {d1}|the {W} Gallery is shut|hike up {W} Peak|{W} Science Fair, stand {d2}|tour of {W} Castle|the {W} Olympiad in May|{W} Football Club lost|staff of the {W} Hospital|{W} Book Club, week {d1}|quiz on {W} Bridge|{W} Workbook, unit {d1}|{W} Atlas missing
Besuch im {W}-Museum|Gymnasium {W} spielt mit|Ausflug an den {W} See|Buch „{W} im Schnee“|Schule am {W} Tor|das {W}-Turnier|Reise nach {W}|École {W} fermée|lycée {W} en tête|livre « {W} la nuit »|coupe de {W}|voyage à {W}|musée de {W}|colegio {W} cierra|libro «{W} de noche»|viaje a {W}|copa de {W}|museo de {W}|escola {W} fechada|viagem a {W}|поездка в музей|школа №{d2} закрыта|кубок города|книга «Лунный сад»|{W}小学校と合同。|{W}博物館を見学。
course {U}-{d3} moved|code {U}{d3}-{c}|{U}-{d4} is full|class {d1}{c} waits|section {c}{d2} only|badge S{d5}|student no. {d6}|learner {U}-{d5}|member {d5}|locker {d3}|ISBN 978-{d1}-{d2}-{d6}-{d1}|ISBN 979-{d2}-{d3}-{d4}-{d1}|book no. {d3}-{d4}|978-{d1}-{d3}-{d5}-{d1}|979-{d2}-{d2}-{d6}-{d1}|reprint 978-{d1}-{d2}-{d5}-{d2}|atlas 978-{d2}-{d4}-{d3}-{d1} due|978 {d1} {d4} {d4} {d1}|978{d10}|shelf {d3}.{d2}|order {d8}|ticket #{d6}|invoice {d4}-{d5}|batch {d10}|serial {U}{d8}|barcode {d13}|asset {d4}-{d3}|parcel {U}{d2}-{d6}|case {d2}/{d4}|rev. {d1}.{d2}.{d2}|build {d1}.{d1}.{d3}|v{d1}.{d2}.{d1} is out|row {d2}-{d2}|pages {d2}-{d3}|tracks {d1}, {d1} and {d2}
on 20{e2}-0{f1}-1{d1} at 1{d1}:{e2}|since 1{d1}/0{f1}/20{e2}|until 1{d1}.0{f1}.20{e2}|from 0{f1}.1{d1}. on|2{h1}.0{f1}.20{e2}, {d2} Punkte|le 1{d1}/0{f1} à midi|el 1{d1} de mayo|в 1{d1}:{e2}, {d2} баллов|{d1}月{d1}日は{d2}点。|{d2}人が参加。|20{e2}年{f1}月に完成。|{d2}頁まで。|{d1}年{d1}組の掃除。|between {d2} and {d2}%|{d2}/{d2} correct|scores {d2}, {d2}, {d2}|rate {d2}.{d2} to {d2}.{d2}|±{d2} is fine|{d3} cm tall|{d2} x {d2} mm|{d1} @ {d2} cents|{d2} pieces @ {d1}.{d2}|{d4} steps|{d2}:{e2} sharp|room {d1}.{d2}|gate {c}{d2}|bus {d3}|Note {d1}-|level {d1}+|= {d3}{d4}|total {d7}|sum {d3},{d3}.{d2}|{d3} {d3} litres|{d2} {d2} {d2}|{d10}|{d6}
https://{w}.test/p/{d5}|see http://wiki.{w}.example/{w}/{d3}|www.{w}.org|www.{w}.test/{d4}|{w}.example|docs.{w}.invalid|@{w}|@{w}.example|{w}@|{w}.{w}@|{w}@ {w}|{w}@{w}|{w}@.test|@ {w}.test|{w} at home|n/a|none|-|unknown|tbd|same as above|ask later|bounced|no address|not given|declined|??|x|none yet|to follow|see file|nil|empty|error {d3}|smtp {d3} {d1}.{d1}.{d1}|mx.{w}.net|{w}.com|list {d5}|id {d5}|k. A.|sans|ninguno|нет|なし|不明|未記入|後日|mailer daemon|desk {d2}|box office|front desk|@home|meet @ noon|café @ {d2}|RE: order {d5}
""")

_TITLES = ("Mr", "Mrs", "Ms", "Mr.", "Dr", "Dr.", "Prof.", "Herr", "Frau", "Mme", "M.", "Sr.", "Sra.", "Señora", "Senhor", "Miss", "Coach")
_PREFIX = ("Yes", "No", "Note", "Also", "But", "And", "Then", "Later", "Well", "OK", "So", "Today", "Then again")


def _everyday(m: Maker) -> str:
    """A sentence without any item, of everyday words."""
    k = m.r.random()
    if k < 0.24:
        noun = m.pick(_HAN_WORDS) if m.r.random() < 0.8 else m.pick(_KANA_WORDS)
        more = m.pick(("の" + m.pick(_HAN_WORDS), "と" + m.pick(_HAN_WORDS), "", "", "、" + m.pick(_HAN_WORDS), m.pick(_HAN_WORDS), "先生方", "会"))
        return noun + more + m.pick(_HAN_VERBS)
    start, thing, end = (x.split("|") for x in _EVERYDAY[m.pick(("en", "en", "de", "de", "fr", "es", "ru"))])
    t = f"{m.pick(start)} {m.pick(thing)} {m.pick(end)}".strip()
    k = m.r.random()
    if k < 0.05:
        return t.upper()
    if k < 0.1:
        return f"{m.pick(_PREFIX)}, {t[0].lower()}{t[1:]}"
    if k < 0.2:
        return f"{t}, {m.pick(thing)}{m.pick((' OK', ' fine', '', '!', '?'))}"
    if k < 0.3:
        return f"{m.pick(thing).split()[-1].capitalize()}: {t[0].lower()}{t[1:]}"
    if k < 0.36:
        return f"{m.pick(thing).split()[-1].capitalize()} {m.pick(end)} ({m.digits(m.r.randint(1, 3))})"
    if k < 0.4:
        return " ".join(w.capitalize() for w in m.pick(thing).split()) + f" {m.digits(2)}"
    return t


def _plain(m: Maker, t: str) -> str:
    def fill(x: re.Match) -> str:
        k = x.group(1)
        if k[0] == "d":
            return m.digits(int(k[1:]))
        return {"W": m.word, "w": lambda: re.sub(r"[^a-z]", "", m.word().lower()) or "web", "U": lambda: re.sub(r"[^A-Z]", "", m.word().upper())[:4] or "AB", "c": lambda: m.pick("ABCDE"), "e2": lambda: m.pick(("21", "24", "25", "30", "45")), "f1": lambda: m.pick("123456789"), "h1": lambda: m.pick("012345678")}[k]()

    return re.sub(r"\{(d\d+|W|w|U|c|e2|f1|h1)\}", fill, t)


def labelled(rows: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """rows texts, each with the spans (start, end, kind) of its items."""
    m = Maker(seed)
    out = []
    for _ in range(rows):
        parts: list[tuple[str, list]] = []
        for _ in range(m.r.choice((1, 1, 2, 3, 4))):
            k = m.r.random()
            if k < 0.45:
                t, gold, pos, text = m.pick(WITH_ITEMS), [], 0, ""
                for x in re.finditer(r"\{([A-Z])\}", t):
                    text += t[pos : x.start()]
                    if x.group(1) == "L" and m.r.random() < 0.12 and not text.rstrip().endswith(_TITLES):
                        text += m.pick(_TITLES) + " "
                    v = m.slot(x.group(1))
                    gold.append((len(text), len(text) + len(v), _KIND[x.group(1)]))
                    text += v
                    pos = x.end()
                text += t[pos:]
                if m.r.random() < 0.25 and text[:1].islower() and not (gold and gold[0][0] == 0):
                    text = text[0].upper() + text[1:]
                parts.append((text, gold))
            elif k < 0.65:
                text = _plain(m, m.pick(WITHOUT))
                parts.append((text[:1].upper() + text[1:] if m.r.random() < 0.3 else text, []))
            else:
                parts.append((_everyday(m), []))
        sep = m.pick((". ", "; ", " / ", "\n", " - ", ". ", " | ", ", ", " "))
        text, gold = "", []
        for i, (t, g) in enumerate(parts):
            if i:
                text += "" if text.endswith("。") else sep if sep not in (", ", " ") or not (g or parts[i - 1][1]) else "; "
            gold += [(len(text) + a, len(text) + b, k) for a, b, k in g]
            text += t
        if m.r.random() < 0.07 and len(text.lower()) == len(text) and all(k in ("name", "phone", "email") for *_, k in gold):  # all in small letters
            text = text.lower()
        out.append((text + m.pick(("", ".", "")), gold))
    return out


def fixed_pieces(least: int = 12) -> list[str]:
    """The fixed wording between the slots, in pieces of at least so many characters, and the hosts."""
    everyday = [x for group in _EVERYDAY.values() for part in group for x in part.split("|")]
    whole = [p for t in [*WITH_ITEMS, *WITHOUT] for p in re.split(r"\{\w+\}", t)]
    return sorted({p.strip() for p in [*whole, *everyday, *_HAN_WORDS, *_HAN_VERBS] if len(p.strip()) >= least})
