"""Synthetic personal information in many forms and carriers, to train and test the tagger in ``pii``.

Nothing here is taken from a corpus: items are drawn at random from general forms, names from common and invented ones, and each stands in one of many general
carriers. ``item`` and ``carried`` can leave out a part of the carriers and names, which a test then holds the trained tagger against.
"""

from __future__ import annotations

import random
from zlib import crc32

KINDS = ("email", "phone", "idnum", "address", "name")

#: Common given and family names of several languages, and words that streets, hosts and places are called by.
GIVEN = """Rose Mark Will Grace Hope Dawn Frank Lily Iris Jade Ruby Faith Joy Daisy Chase Grant Miles Drew James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Steven Sandra Paul Ashley Andrew Emily
    Joshua Kimberly Kevin Donna Brian Michelle George Carol Edward Amanda Ronald Melissa Timothy Deborah Jason Stephanie Jeffrey Rebecca Ryan Sharon Gary Laura Jacob Cynthia Nicholas Amy Eric Kathleen Jonathan Angela Larry Anna
    Hans Greta Klaus Ingrid Jürgen Heike Stefan Anke Lars Freya Sven Astrid Björn Elsa Pierre Camille Luc Amélie Jean Chloé René Giulia Marco Chiara Luca Sofia Matteo Elena Carlos María José Lucía Diego Carmen Javier Pilar Mateo
    João Beatriz Tiago Inês Paulo Joana Piotr Agnieszka Marek Katarzyna Tomasz Ewa Mehmet Ayşe Mustafa Elif Emre Zeynep Budi Siti Agus Dewi Ivan Olga Dmitri Natasha Sergei Irina Hiroshi Yuki Takashi Keiko Wei Mei Ahmed Fatima Omar Layla
    Aarav Diya Rohan Anika Kwame Ama Femi Ngozi Noor Tariq Amir Samira Oscar Ivy Felix Clara Leo Nora Max Ida Theo Alma Hugo Rosa Otto Vera Jasper Esther Milo June Silas Pearl Ezra Wren Cormac Maeve Declan Niamh""".split()
FAMILY = """Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Nguyen Hill Green
    Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Koch Bauer Richter Wolf Schröder Neumann Zimmermann Krüger Lindqvist Johansson Andersson Nilsson Berg
    Dubois Moreau Lefebvre Girard Bonnet Rousseau Fontaine Rossi Ferrari Esposito Bianchi Romano Colombo Ricci Fernández González Pérez Sánchez Ramírez Torres Silva Santos Oliveira Pereira Costa Almeida Kowalski Nowak Wiśniewski Zieliński
    Yılmaz Kaya Demir Şahin Wijaya Santoso Hartono Ivanov Petrov Sokolov Volkov Morozov Tanaka Suzuki Watanabe Yamamoto Nakamura Chen Wang Zhang Hassan Hussein Khan Patel Sharma Singh Okafor Mensah Adeyemi O'Brien O'Neill McCarthy Fitzgerald
    van Dijk de Vries Jansen Bakker Visser Smit Mulder Lund Holm Dahl Haugen Nagy Horváth Popescu Novák Svoboda Papadopoulos""".replace("van Dijk", "Vandijk").replace("de Vries", "Devries").split()
WORDS = """maple oak cedar birch river lake hill stone mill church station market garden park forest meadow sunset harbor bridge castle king queen north south spring winter elm walnut willow chestnut valley canyon prairie
    amber copper silver iron glass paper violet rose lily fox hawk eagle otter badger linden rosen berg wald bach feld brunnen mühlen schiller goethe olmo pozo sol luna flores fuente molino lilas moulins église roses verdi garibaldi
    roma dante molen kerk dorp storm sjö lipowa polna kwiatowa atlas orbit pixel signal lantern kettle piston anvil velvet marble cobalt quartz raven comet ember drift harvest summit""".split()
STREETS = """Street|St|St.|Road|Rd|Rd.|Lane|Ln|Avenue|Ave|Ave.|Drive|Dr|Court|Ct|Terrace|Boulevard|Blvd|Way|Place|Pl|Square|Close|Crescent|Row|Parkway|Hill|Grove|Gardens|Mews|Walk|Trail|Loop|Circle|Highway|Alley|Quay|Path|Green|Rise|View""".split("|")
_VOWELS, _ONSETS, _CODAS = "aaeeiioou", "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sh st t th tr v w y z".split(), ["", "", "", "n", "r", "s", "l", "t", "k", "ck", "nd", "rg", "th", "m", "x", "ll", "st"]
_ENDINGS = "son sen berg mann stein field ford ton well worth ley by wick man ski sky ov ova ez es ini elli ucci eau ard off dottir baum feld hurst more dale land er iu ak uk oğlu nen".split()


def invented(rng: random.Random, syllables: int) -> str:
    return "".join(rng.choice(_ONSETS) + rng.choice(_VOWELS) + rng.choice(_CODAS) for _ in range(syllables)).capitalize()


def in_part(word: str, part: int | None, parts: int = 5) -> bool:
    """Whether a carrier or name is of the ``part``-th of ``parts`` parts of all; of none if part is None."""
    return part is not None and crc32(word.encode()) % parts == part


def _digits(rng: random.Random, form: str) -> str:
    """A form with each # a digit, each ! a digit from 2, each A a letter."""
    return "".join(rng.choice("0123456789") if c == "#" else rng.choice("23456789") if c == "!" else rng.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "A" else c for c in form)


#: Forms of telephone numbers and of the numbers of official documents.
PHONES = """(!##) !##-####|(!##) !## ####|!##-!##-####|!##.!##.####|!## !## ####|!##!######|1-!##-!##-####|1 (!##) !##-####|+1 !## !## ####|+1-!##-!##-####|+1 (!##) !##-####|+1!##!######|+44 #### ######|+44 ## #### ####|+44##########|+44 (0)## #### ####|
    +49 ### #######|+49 ## ########|+49##########|+49 (0)### ######|+33 # ## ## ## ##|+33#########|+34 ### ### ###|+34 ### ## ## ##|+39 ### #######|+39 ## #### ####|+31 # ########|+46 ## ### ## ##|+48 ### ### ###|+351 ### ### ###|+55 ## #####-####|
    +90 ### ### ## ##|+62 ### #### ####|+7 ### ###-##-##|+7 (###) ###-##-##|+81 ## #### ####|+91 ##### #####|+86 ### #### ####|0# ## ## ## ##|0#.##.##.##.##|0#-##-##-##-##|0## #######|0## ### ## ##|0###/######|0###-######|0### ######|0## / #### ###|0##/##### ###|
    0#### ######|0#########|0## #### ####|# ## ## ## ##|## ### ## ##|### ## ## ##|### ### ###|!##-####|!##.####|# # # # # # # # # #|# # # # # # #|## ## ## ## ##|(0##) ### ## ##|(0###) ######|(##) #####-####|00## ### ### ####|00## ## #### ####|8 (###) ###-##-##""".replace("\n", "").replace("    ", "").split("|")
IDS = """###-##-####|### ## ####|###-00-####|### 00 ####|A#######|A########|AA#######|AA######|AA ## ## ## A|AA######A|AA######A#|#########|########A|########-A|A-#######-A|A#######A|###.###.###-##|##.###.###-#|######-####|########-####|#### #### ####|A###-####-####|A### #### ####|A##-###-###-###|####-###-####-#|
    AAAAA######AA#AA|AAA######|A##A#####|##AA#####|AA-#######|AA ### ###|###########|## ######## #|AAAAAA##A##A###A|A######(#)|#-####-#####-##-#|AA#########|A## ### ###|##-#######|#######-#|###### ######""".replace("\n", "").replace("    ", "").split("|")
#: What stands before the number of an official document. {} is the number's place.
ID_CARRIERS = """my passport is {}|passport number {}|passport no. {}|passport no {} expired|my passport ({}) was stolen|ssn {}|my ssn is {}|social security number {}|social {} please keep it private|soc sec {}|my social security is {} ok|id card {}|my id is {}|national id {}|national identity number {}|identity card no {}|id number: {}|
    driver license {}|driving licence {}|my license {} is expired|license number {}|dl# {}|Ausweis {}|Personalausweis Nr. {}|mein Ausweis {} ist weg|Reisepass {}|DNI {}|mi DNI es {}|NIE {}|pasaporte {}|CURP {}|carte d'identité {}|passeport n° {}|numéro de sécu {}|codice fiscale {}|carta d'identità {}|passaporto {}|
    CPF {}|meu CPF é {}|RG {}|BSN {}|mijn BSN is {}|paspoort {}|personnummer {}|mitt personnummer är {}|PESEL {}|dowód {}|TC kimlik {}|kimlik no {}|NIK {}|KTP saya {}|паспорт {}|СНИЛС {}|tax id {}|national insurance {}|NI number {}|my insurance number is {} they said|Aadhaar {}|they copied my passport {} and my name|the clerk wrote {} as my social security number|it says {} on my driving licence|{} is my passport number""".replace("\n", "").replace("    ", "").split("|")
PHONE_CARRIERS = """call {}|call me at {}|call me on {} after six|call {} now|text {}|text me on {} ok|phone: {}|tel {}|tel. {}|tel: {}|mobile {}|cell {}|my number is {}|my number: {}|new number {}|reach me at {}|whatsapp {}|WhatsApp me {}|signal: {}|fax {}|hotline {}|dial {} for info|the shop's number is {}|for parts {}|{} call anytime|{} is my cell|
    in case of questions: {}|meine Nummer ist {}|Telefon {}|Handy {}|llámame al {}|mi número es {}|teléfono {}|appelle moi au {}|mon numéro {}|chiamami al {}|il mio numero è {}|me liga no {}|meu número {}|bel me op {}|mijn nummer is {}|ring mig på {}|mój numer {}|zadzwoń {}|beni ara {}|hubungi {}|nomor saya {}|звони {}|мой номер {}|電話 {}|leave a message at {}|i can be reached under {} all day|sms to {}|booking {}|business inquiries {}|contact {}|he gave me {} as his number|or {} if nobody answers""".replace("\n", "").replace("    ", "").split("|")
EMAIL_CARRIERS = """mail me at {}|email me at {}|email: {}|e-mail {}|my email is {}|write to {}|write me: {}|send it to {}|contact {}|contact us at {}|reach me at {}|{} is my address|business inquiries {}|for work {}|questions to {}|ask {}|dm or {}|cc {}|support {}|newsletter at {}|schreib mir an {}|meine Mail ist {}|escríbeme a {}|mi correo es {}|
    écris moi à {}|mon mail {}|scrivimi a {}|la mia mail è {}|meu email é {}|mail me op {}|mejla mig på {}|napisz na {}|bana yaz {}|email saya {}|пиши на {}|моя почта {}|メール {}|forward it to {} thanks|just mail {} and i will answer|you can find me under {}|signed up with {}|my old address {} is dead|paypal {}|invoice to {}""".replace("\n", "").replace("    ", "").split("|")
ADDRESS_CARRIERS = """i live at {}|we live at {} and it is loud|my address is {}|address: {}|my house is {}|send it to {}|send letters to {}|ship it to {} please|deliver to {} by monday|visit us at {}|come to {}|meet at {}|meet me at {}|the shop is at {}|the office at {} is closed|filmed in front of {}|parked at {}|the accident was at {}|moved to {}|moving from {} next month|
    grew up at {}|grandma still lives at {}|party at {} tonight|the package went to {}|pick it up at {}|for sale: {}|apartment at {} for rent|ich wohne {}|wir wohnen in der {}|Adresse: {}|schick es an {}|vivo en {}|mi dirección es {}|j'habite {}|mon adresse {}|abito in {}|moro na {}|ik woon op {}|jag bor på {}|mieszkam {}|adresim {}|alamat saya {}|живу по адресу {}|that is {} on the left|is this {}?|the corner house, {}|look up {} on the map""".replace("\n", "").replace("    ", "").split("|")
NAME_CARRIERS = """my name is {}|my name is {} and i made this|hi i am {}|i'm {} by the way|this is {} speaking|regards, {}|best regards {}|kind regards, {}|sincerely, {}|yours, {}|thanks, {}|signed {}|- {}|cheers {}|love from {}|greetings to {}|shout out to {}|thank you {}|thanks to {}|dear {}|hello {}|hey {} if you read this|happy birthday {}|rip {}|rest in peace {}|in memory of {}|congrats to {}|
    contact {}|ask {} about it|talk to {}|call {} for help|written by {}|music by {}|directed by {}|photo by {}|starring {}|interview with {}|a talk by {}|the teacher was {}|my teacher {} showed us|my boss {} hates it|my neighbor {} has one|my uncle {} built it|my doctor, {}, said so|our coach {} retired|i met {} once|i know {} from work|i grew up with {}|i worked with {}|
    married to {}|{} taught me that|{} told me about it|{} said hello|{} was there too|{} lives next door|{} works here|{} sent me this|{} and i watched it|{} is my cousin|{} died last year|{} (my boss) agreed|{}, our mayor, opened it|{} from accounting|i think it was {}|is {} in this one|looks like {} in the back|someone named {}|a man called {}|the winner is {}|arrested: {}|wanted: {}|mit freundlichen Grüßen {}|ich heiße {}|
    mein Name ist {}|viele Grüße von {}|mein Lehrer {}|danke an {}|me llamo {}|saludos de {}|mi profesor {}|je m'appelle {}|cordialement, {}|merci à {}|mi chiamo {}|saluti da {}|meu nome é {}|um abraço de {}|mijn naam is {}|groeten van {}|jag heter {}|hälsningar {}|nazywam się {}|pozdrawia {}|benim adım {}|nama saya {}|меня зовут {}|с уважением {}|you reminded me of {} a lot|nobody believed {} back then|it says {} on the box|the invoice went to {}|{} please call me back|i owe {} money|vote for {}|fire {}|free {}|team {}""".replace("\n", "").replace("    ", "").split("|")
#: What looks like an item and is none. {d} a run of digits, {w} a word, {W} a capital word, {G} a given name, {F} a family name, {P} an invented place.
OTHERS = """order number {d}|order #{d}{d}|invoice {d}{d}|invoice no. {d}-{d}|serial {d} {d}|serial number {d}{d}{d}|version {n}.{n}.{n}|v{n}.{d}|firmware {d}.{n}|isbn 978-{n}-{d}-{d}-{n}|tracking {d}{d}{d}|tracking number {W}{d}{d}|ticket {d}|ref {d}/{d}|part no {d}-{W}-{n}|model {W}{d}|score {n}-{n}|at {n}:{d2}|{d2}:{d2}:{d2}|from {d2}:{d2} to {d2}:{d2}|
    {d4}-{d2}-{d2}|{d2}/{d2}/{d4}|{d2}.{d2}.{d4}|in {d4} and {d4}|{d},{d},{d} views|{d}.{d} views|{d} views in {n} days|pi is 3.14159265358|192.0.{n}.{d}|10.{n}.{n}.{n}|port {d4}|iban DE{d2} {d4} {d4} {d4} {d4} {d2}|iban GB{d2}ABCD{d4}{d4}{d4}|visa {d4} {d4} {d4} {d4}|{n}x{d2}x{d}|{d} ohm|{d}.{n} khz|{d}kg|{n} of {d}|page {d}|chapter {n}|episode {d}|room {d}|bus {d}|highway {d}|flight {W}{d4}|
    lottery {n} {d2} {d2} {d2} {d2}|step {n}, step {n}|{n} {w} {n} {w} {n} {w}|{d2} {w} and {d2} {w}|{d} years of {w}|{n}th street art|the street was long|down the road|{d} streets later|{d} roads to {P}|a lane of {w}|road trip {d}|{d} avenue q fans|the way home|{w}@{n}.{n}.{n}|@{w}{w}|@{w}_{d2}|follow @{w}.{w}|user {w}{d}|{w}.{w} is a file|www.{w}.example|https://{w}.example/{w}/{d}|{w}.example|a dot at the end|at {w} dot by dot|
    {G} is great|thanks {G}|{G} and {G}|{G}, {G} and {G}|ask {G} about the {w}|{G}'s {w} is nice|mr {F}|Mrs. {F}|Dr. {F}|professor {F} was right|the {F} family|the {F} method|{F} street art|{F} et al|King {G}|Saint {G}|Queen {G}|the {W} {W}|{W} {W} is a band|{W} and {W}|Lake {W}|Mount {P}|New {P}|San {P}|Port {P}|North {P}|the {P} {W}|{P} {W} bias|{P} University|University of {P}|{P} Airport|{P} United|in {P}|from {P}|near {P}|between {P} and {P}|
    {P} {w} at {n}:{d2}|Blue {W}|Red {W} {W}|Happy Birthday|Merry Christmas|Good Morning|Part Two|Season Finale|Grand Opening|hope it works|rose water|may be late|let me be frank|in the dawn light|grace period|the jasper stone|summer rain|May the fourth|April showers|Paris in June|Georgia is warm|{W} {W} {W} {W}|{w} {w} {w}|channel {W} {W}|{W}TV|subscribe to {W} {W}|play {W} {W} again|{d4}x{d4} at {d} fps|ratio {n}:{n} at {d} fps|{d4} MHz and {d2} dB|ping 192.0.{n}.{d}|ip 10.{n}.{n}.{d2}|thank you|so good|this aged well|never {w} so {w}|my {w} said so|the {w} {w} of {P}|{w} and {w} and {w}|you {L}|so {L} lol|what a {L} {w}|{L} {L}|{L}|at {n}am|watching this at {n}am|{d2}pm in {P}|{n}k views|{d2}fps|{n}th time|in 4k at 60fps|number {n} {w}|{n} {w} out of {d2}|{W} {W} Part {n}|from {W} to {W}""".replace("\n", "").replace("    ", "").split("|")


def _word(rng: random.Random) -> str:
    return rng.choice(WORDS) if rng.random() < 0.6 else invented(rng, rng.choice((1, 2, 2))).lower()


def _plain(x: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", x) if c.isascii())


def email(rng: random.Random, part: int | None = None) -> str:
    a, b = _plain(_word(rng)), _plain(_word(rng))
    local = rng.choice((a, f"{a}.{b}", f"{a}_{b}", f"{a}-{rng.randint(1, 999)}", f"{a}{rng.randint(1, 99)}", f"{a}.{b}{rng.randint(1, 99)}", f"{a[0]}.{b}", f"{a}+{b}", f"{rng.choice(GIVEN)}.{rng.choice(FAMILY)}", f"{a}{b}"))
    local = _plain(local).replace("'", "")
    host = [_plain(_word(rng)) for _ in range(rng.choice((1, 1, 1, 2)))]
    if rng.random() < 0.2:
        host[0] += f"-{_plain(_word(rng))}"
    host.append(rng.choice("com org net de fr es it example test io co.uk edu info mail post biz nl se pl me app".split()))
    how = rng.random()
    if how < 0.5:
        at, dot = "@", "."
    elif how < 0.72:
        o, c = rng.choice(("()", "[]", "{}", "<>"))
        gap = rng.choice((" ", " ", ""))
        at, dot = f"{gap}{o}at{c}{gap}", rng.choice((f"{gap}{o}dot{c}{gap}", f"{gap}{o}dot{c}{gap}", "."))
    elif how < 0.9:
        at, dot = rng.choice((" at ", " AT ", " at ")), rng.choice((" dot ", " DOT ", " dot "))
    else:
        at, dot = rng.choice((" @ ", "@ ", " @")), "."
    out = local + at + dot.join(".".join(host).split("."))
    if rng.random() < 0.06:
        k = rng.randrange(1, len(out))
        out = out[:k] + rng.choice("​­‌") + out[k:]
    return out


def phone(rng: random.Random, part: int | None = None) -> str:
    return _digits(rng, rng.choice(PHONES))


def idnum(rng: random.Random, part: int | None = None) -> str:
    out = _digits(rng, rng.choice(IDS))
    return out.lower() if rng.random() < 0.06 else out


def address(rng: random.Random, part: int | None = None) -> str:
    big = lambda: (_word(rng) if rng.random() < 0.7 else invented(rng, 2)).capitalize()
    n = rng.choice((rng.randint(1, 99), rng.randint(1, 999), rng.randint(1, 9999)))
    number = f"{n}{rng.choice(('', '', '', '', 'a', 'B', 'c'))}"
    joined = big() + _word(rng) if rng.random() < 0.4 else big()
    how = rng.random()
    if how < 0.5:
        street = " ".join(rng.choice((joined, big())) for _ in range(rng.choice((1, 1, 2))))
        unit = ""
        if rng.random() < 0.35:
            unit = rng.choice((", ", " ", ". ", ", ")) + rng.choice((f"Apt {rng.randint(1, 99)}", f"Apt. {rng.randint(1, 20)}{rng.choice('ABC')}", f"Unit {rng.randint(1, 99)}", f"#{rng.randint(1, 300)}", f"Flat {rng.randint(1, 40)}", f"Suite {rng.randint(100, 900)}", f"Floor {rng.randint(1, 20)}", f"Room {rng.randint(1, 300)}", f"Apartment {rng.randint(1, 40)}"))
        kind = rng.choice(STREETS)
        return f"{number} {rng.choice(('', '', '', 'N ', 'West '))}{street} {kind.rstrip('.') if not unit or unit[0] == '.' else kind}{unit}"
    if how < 0.68:
        a = rng.choice((f"{joined}{rng.choice('straße strasse weg gasse platz allee str. ring ufer damm'.split())}", f"{big()} {rng.choice('Straße Weg Platz Allee Gasse'.split())}", f"{rng.choice(('Am', 'An der', 'Im', 'Zum'))} {big()}", f"{joined}{rng.choice('straat laan gracht weg plein gatan vägen gränd'.split())}", f"ul. {big()}", f"{big()} {rng.choice(('Sokak', 'Caddesi'))}", f"Jalan {big()}", f"Jl. {big()}"))
        return f"{a} {rng.choice(('', '', '', 'Nr. ', 'No. '))}{number}"
    if how < 0.85:
        a = rng.choice("Calle Avenida Plaza Paseo Rua Via Viale Piazza Avenida Camino Travessa Corso Carrera".split())
        link = rng.choice(("", "", "de ", "del ", "de la ", "de los ", "das ", "do ", "della ", "dei "))
        return f"{a} {link}{big()}{rng.choice((' ', ', ', ', ', ' nº ', ' n. ', ', nº ', ' n° '))}{number}"
    a = rng.choice("rue avenue boulevard place chemin impasse quai allée route".split())
    link = rng.choice(("", "de ", "du ", "des ", "de la ", "d'", "de l'"))
    return f"{number}{rng.choice(('', '', ' bis', ' ter'))}{rng.choice((' ', ', '))}{a} {link}{big()}{rng.choice(('', '', ' ' + big()))}"


def name(rng: random.Random, part: int | None = None, inside: bool = False) -> str:
    """A full name. Listed ones of ``part`` are left out, or with ``inside`` only those are taken; invented ones are always new."""
    pick = lambda names: rng.choice([x for x in names if in_part(x, part) == inside] if part is not None else names)
    given = pick(GIVEN) if rng.random() < 0.55 else invented(rng, rng.choice((1, 2, 2, 3)))
    how = rng.random()
    family = pick(FAMILY) if how < 0.35 else invented(rng, rng.choice((1, 1, 2))) + rng.choice(_ENDINGS) if how < 0.65 else invented(rng, rng.choice((2, 2, 3)))
    if rng.random() < 0.05:
        family = f"{family}-{pick(FAMILY)}"
    middle = f" {rng.choice('ABCDEFGHIJKLMNOPRSTVW')}." if rng.random() < 0.18 else ""
    out = f"{family}, {given}" if rng.random() < 0.13 else f"{given}{middle} {family}"
    return rng.choice((str, str, str, str, str.lower, str.upper))(out)


CARRIERS = {"email": EMAIL_CARRIERS, "phone": PHONE_CARRIERS, "idnum": ID_CARRIERS, "address": ADDRESS_CARRIERS, "name": NAME_CARRIERS}
MAKE = {"email": email, "phone": phone, "idnum": idnum, "address": address, "name": name}


def carried(kind: str, rng: random.Random, part: int | None = None, inside: bool = False) -> tuple[str, int, int]:
    """(sentence, begin, end) of an item of a kind in a carrier. Carriers and names of ``part`` are left out, or with ``inside`` only those are taken."""
    carriers = [c for c in CARRIERS[kind] if in_part(c, part) == inside] if part is not None else CARRIERS[kind]
    item = name(rng, part, inside) if kind == "name" else MAKE[kind](rng)
    if kind != "idnum" and not inside and rng.random() < 0.25:
        # Any words may stand around an item.
        carrier = " ".join(_word(rng) for _ in range(rng.randint(0, 4))) + " {} " + " ".join(_word(rng) for _ in range(rng.randint(0, 3)))
    else:
        carrier = rng.choice(carriers)
    a, b = carrier.strip().split("{}")
    if rng.random() < 0.14:
        # Items may stand in brackets or after a colon, or begin a sentence.
        around = rng.choice(("()", "()", "<>", "[]", "\"\"", "''", ": ", "->", "--", "  "))
        a, b = rng.choice(((a + around[0], around[1] + b), (a + around[0], around[1] + b), ("", f" - {_word(rng)} {_word(rng)}"), ("", f" was {_word(rng)} on the {_word(rng)}"), (around[0], around[1] + b)))
    if rng.random() < 0.3 and a:
        a = a[0].upper() + a[1:]
    if rng.random() < 0.04:
        a, b = a.upper(), b.upper()
    return a + item + b, len(a), len(a) + len(item)


def other(rng: random.Random) -> str:
    """A sentence with something that looks like an item and is none."""
    import re

    def hidden() -> str:
        """A word with digits, marks or dots for letters."""
        w = _plain(_word(rng))
        how = rng.random()
        return "".join({"o": "0", "i": "1", "e": "3", "a": "4", "s": "5"}.get(c, c) for c in w) if how < 0.4 else rng.choice(".-_ *").join(w) if how < 0.8 else w[0] + "*" * (len(w) - 1)

    fill = {"L": hidden, "d": lambda: _digits(rng, rng.choice(("###", "####", "#####", "######"))), "d2": lambda: _digits(rng, "##"), "d4": lambda: _digits(rng, "####"), "n": lambda: str(rng.randint(1, 9)), "w": lambda: _word(rng), "W": lambda: _word(rng).capitalize(), "G": lambda: rng.choice(GIVEN), "F": lambda: rng.choice(FAMILY), "P": lambda: invented(rng, rng.choice((2, 2, 3)))}
    return re.sub(r"\{(\w+)\}", lambda m: fill[m[1]](), rng.choice(OTHERS))


def renewed(text: str, marks: list[tuple[int, int, str]], rng: random.Random, part: int | None = None, inside: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with most of its marked items replaced by new ones of their kind."""
    out, spans, last = "", [], 0
    for a, b, kind in marks:
        item = text[a:b] if rng.random() < 0.3 else name(rng, part, inside) if kind == "name" else MAKE[kind](rng)
        out += text[last:a]
        spans.append((len(out), len(out) + len(item), kind))
        out, last = out + item, b
    return out + text[last:], spans


def document(backgrounds: list[tuple[str, list[tuple[int, int, str]]]], rng: random.Random, part: int | None = None, inside: bool = False, plain: float = 0.5) -> tuple[str, list[tuple[int, int, str]]]:
    """(text, spans): some carried items and look-alikes around a background text, or with probability ``plain`` a background by itself.

    ``backgrounds`` are (text, spans); items marked there are replaced by others.
    """
    pieces: list[tuple[str, list[tuple[int, int, str]]]] = []
    alone = bool(backgrounds) and rng.random() < plain
    if backgrounds and (alone or rng.random() < 0.8):
        text, marks = rng.choice(backgrounds)
        pieces.append(renewed(text, marks, rng, part, inside))
    for _ in range(0 if alone else rng.choice((0, 1, 1, 1, 1, 2))):
        kind = rng.choice((*KINDS, "name", "name"))
        text, a, b = carried(kind, rng, part, inside)
        pieces.insert(rng.randint(0, len(pieces)), (text, [(a, b, kind)]))
    for _ in range(0 if alone else rng.choice((0, 0, 1, 1))):
        text = other(rng)
        pieces.insert(rng.randint(0, len(pieces)), (rng.choice((str, str, str, str.capitalize))(text), []))
    out, spans = "", []
    for k, (text, marks) in enumerate(pieces):
        if k:
            out += rng.choice((". ", ". ", " ", ", ", "\n", " - ", "! ", "... ", "? ")) if out[-1:] not in ".!?" else rng.choice((" ", "\n"))
        spans += [(len(out) + a, len(out) + b, kind) for a, b, kind in marks]
        out += text
    out += rng.choice(("", "", ".", "!", " 😂", " please", " lol"))
    how = rng.random()
    if how < 0.04 and len(out.upper()) == len(out):
        out = out.upper()
    elif how < 0.09 and len(out.lower()) == len(out):
        out = out.lower()
    return out, spans
