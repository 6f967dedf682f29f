"""Invented sentences with labelled personal details in eight languages, for training the tagger.

Every part is made here: carriers are written for this module, names are drawn
from short lists and syllables, numbers from general national formats. Nothing
is taken from a table.
"""

from __future__ import annotations

import random

# Building blocks of invented names and places.
GIVEN = "Anna Ben Clara David Emma Felix Grace Henry Ines Jack Karla Leo Maya Noah Olivia Paul Quentin Rosa Simon Tara Umar Vera Walter Xenia Yara Zoe Dave Priya Tom Jane Gregory Deborah Miguel Carmen Joao Beatriz Luc Amelie Jurgen Heike Rahul Sunita Bilal Nadia Hana Sami Ngozi Kofi Ivan Olga Linh Mei Hiroshi Bjorn Astrid Sean Niamh Marco Giulia Pedro Lucia Thiago Leticia Pierre Manon Dieter Sabine Ahmed Salma Imran Farah Vijay Kavita".split()
FAMILY = "Hale Raman Becker Smith Jones Garcia Silva Muller Schmidt Dupont Moreau Rossi Khan Sharma Patel Nguyen Okafor Mensah Ivanov Petrova Larsen Murphy Walsh Ferrari Santos Oliveira Fernandez Castro Weber Fischer Laurent Girard Haddad Mansour Iqbal Qureshi Gupta Iyer Tanaka Wong Novak Horvat Kowalski Jensen Lindqvist O'Brien McAllister Fitzgerald Abernathy Blackwood Castellanos".split()
AR_GIVEN = "سامر هدى كريم منى باسم ريم فادي سلمى حسن دلال عمر نجلاء زياد شيماء ماهر غادة".split()
AR_FAMILY = "النجار الخطيب حداد العمري القاسم الشامي درويش السالم البكري المنصور الحلبي الرفاعي".split()
HI_GIVEN = "राहुल सुनीता अमित कविता विजय नेहा संजय पूजा मनोज रेखा अजय मीना सुरेश गीता".split()
HI_FAMILY = "शर्मा वर्मा गुप्ता यादव मिश्रा जोशी पटेल सिंह चौहान तिवारी नायर अय्यर".split()
UR_GIVEN = "عمران فرح بلال نادیہ کاشف صبا ندیم شازیہ فیصل حنا جاوید رابعہ ثاقب عظمیٰ".split()
UR_FAMILY = "قریشی خان ملک چوہدری بٹ شیخ اعوان مرزا صدیقی ہاشمی انصاری رانا".split()
SYLLABLES = [a + b for a in "b br c ch d dr f g gr h j k kr l m n p pr r s sh st t th tr v w y z".split() for b in "a e i o u an en on ar er or al el il ul ai ei ou ath eth isk ock".split()]
WAYS = "Street St Road Rd Lane Ln Avenue Ave Drive Dr Court Ct Close Way Terrace Place Crescent Boulevard Blvd Square Gardens".split()

# {n} a name, {f} a given name alone, {a} an address, {e} an e-mail address, {p} a phone number, {i} an identity number, {d} a number or code that is no personal detail, {m} a moment or amount.
CARRIERS = {
    "en": """
        My name is {n} and I moved to {a} last year.|This is {n} speaking.|Signed, {n}|Kind regards, {n}|Thanks a lot, {f}|- {f}|— {n}|Cheers {f}|best, {f}|You can call {n} on {p} after {m}.|Contact {e} for the keys.|Reach me at {e} or {p}.|Mail: {e}
        My number is {p}, please use it.|Phone {p}.|Please ring {p} before you come.|call me at {p}|text {p} if late|My mobile changed from {p} to {p}.|His cell is {p} and his mail is {e}.|{n} / {e} / {p}|{n}, {e}, {p}|fax {p}, order {d}
        SSN {i} and passport {i}|My passport number is {i}.|Social security number: {i}.|ID card {i}, issued in {m}.|the id you have for me, {i}, is wrong|National insurance {i}.|driving licence {i} expired on {m}|For the form: {n}, {i}.|I am {n}, id {i}
        I live at {a}.|Please deliver to {a} on {m}.|Our new address is {a}.|Nobody was home at {a}.|Pick it up at {a}, ring {p}.|From {a} to {a} it took two hours.|Send the letter to {n}, {a}.|the flat at {a} belongs to {n}|It was left at {a}, where {f} lives.
        {n} and {n} were both at the desk.|I spoke with {f} first and then with {n}.|Somebody called {n} signed for it.|Mrs. {n} came in on {m}.|Dr {n} wrote the note.|Mr {n} never called.|ask {f} about it|The clerk {f} was kind.|Is {n} still your manager?|My son {f} has the receipt.|my sister {n} paid {m}.|Give it to {f}, not to {f}.|{f} told me to wait.|{f}, please answer.|Dear {f},|Hello {f}, thanks for {m}.|Account holder {n}, number {d}.|in the name of {n}|booked for {n} at {m}
        Order {d} has not arrived since {m}.|Invoice {d} says {m}.|Tracking {d} is stuck.|The meter reads {d}.|Batch {d} smells odd.|Model {d} with serial {d} stopped.|Ticket {d} was closed at {m}.|Reference {d}, amount {m}.|It cost {m} and not {m}.|We waited {m} for the technician.|The shop on the corner sells the cake for {m}.|The sign said closed until {m}.|I asked for the red one and got the blue one.|Nobody picks up the phone at the depot.|Your bank charged me {m} twice.|Thanks, it works now.|The blender makes noise like a drill.""",
    "de": """
        Mein Name ist {n}.|Ich bin {n} und wohne in der {a}.|Sie erreichen mich unter {p} oder {e}.|Mit freundlichen Grüßen {n}|Viele Grüße, {f}|- {f}|Rufen Sie {n} an: {p}.|Meine neue Nummer ist {p}.|Bitte an {e} schicken.|Personalausweis {i}.|Meine Steuernummer lautet {i}.|Der Ausweis von {n} hat die Nummer {i}.|Die Lieferung soll in die {a}.|Wir wohnen jetzt {a}.|Herr {n} war um {m} da.|Frau {n} hat unterschrieben.|Gestern sprach ich mit {f} und {n}.|Mein Sohn {f} holt es ab.|Bei {n}, {a}, war niemand.
        Die Rechnung {d} ist falsch.|Bestellung {d} kam um {m}.|Die Sendung {d} steckt fest.|Der Zähler zeigt {d}.|Das kostet {m} statt {m}.|Der Laden war bis {m} zu.|Seit Tagen meldet sich niemand.|Die Torte war zerdrückt.""",
    "fr": """
        Je suis {n}.|Mon nom est {n} et j’habite {a}.|Mon numéro est le {p}.|Appelez {n} au {p}.|Répondez à {e}.|Mon adresse : {a}.|Livraison au {a} avant {m}.|Cordialement, {n}|Merci, {f}|- {f}|Carte d’identité {i}.|Mon numéro de sécurité sociale est {i}.|Passeport {i}.|Madame {n} a signé.|M. {n} est passé à {m}.|J’ai parlé à {f} puis à {n}.|Ma fille {f} est allergique.|Le colis est chez {n}, {a}.
        La facture {d} est fausse.|La commande {d} n’est pas arrivée.|Le suivi {d} ne bouge pas.|Le compteur indique {d}.|Cela coûte {m} et non {m}.|La boutique était fermée jusqu’à {m}.|Personne ne répond depuis lundi.|Le gâteau était écrasé.""",
    "es": """
        Soy {n}.|Mi nombre es {n} y vivo en {a}.|Mi número es {p}.|Llame a {n} al {p}.|Escriba a {e}.|La dirección es {a}.|Envíen el pedido a {a} antes de {m}.|Saludos, {n}|Gracias, {f}|- {f}|Mi DNI es {i}.|Pasaporte {i}.|NIE {i}, fecha {m}.|La señora {n} firmó.|El señor {n} vino a las {m}.|Hablé con {f} y con {n}.|Mi hijo {f} lo recoge.|Está a nombre de {n}, {p}.
        La factura {d} está mal.|El pedido {d} no llegó.|El seguimiento {d} no avanza.|El contador marca {d}.|Cuesta {m} y no {m}.|La tienda estaba cerrada hasta {m}.|Nadie contesta desde el lunes.|La tarta llegó aplastada.""",
    "pt": """
        Sou {n}.|O meu nome é {n} e moro na {a}.|O meu número é {p}.|Ligue a {n} para o {p}.|Escreva para {e}.|A morada é {a}.|Entreguem na {a} antes de {m}.|Cumprimentos, {n}|Obrigada, {f}|- {f}|O meu NIF é {i}.|Passaporte {i}.|O cartão de cidadão é {i}.|A dona {n} assinou.|O senhor {n} veio às {m}.|Falei com {f} e com {n}.|O meu filho {f} vai buscar.|Está em nome de {n}, {p}.
        A fatura {d} está errada.|A encomenda {d} não chegou.|O registo {d} não avança.|O contador marca {d}.|Custa {m} e não {m}.|A loja estava fechada até {m}.|Ninguém responde desde segunda.|O bolo veio esmagado.""",
    "ar": """
        معكم {n}.|الاسم {n} والعنوان {a}.|رقمي {p}.|اتصل بـ {n} على {p}.|البريد {e}.|عنواني {a}.|أرسلوا الطلب إلى {a} قبل {m}.|مع التحية، {n}|شكرا، {f}|- {f}|رقم الهوية {i}.|جواز السفر {i}.|السيد {n} وقع على الاستلام.|السيدة {n} جاءت الساعة {m}.|تحدثت مع {f} ثم مع {n}.|ابني {f} سيأخذه.|الحجز باسم {n}.
        الفاتورة {d} خطأ.|الطلب {d} لم يصل.|الشحنة {d} متوقفة.|العداد يشير إلى {d}.|السعر {m} وليس {m}.|المحل مغلق حتى {m}.|لا أحد يرد منذ أيام.|وصلت الكعكة مهروسة.""",
    "hi": """
        मैं {n} बोल रहा हूँ।|नाम {n}, पता {a}।|मेरा नंबर {p} है।|{n} को {p} पर बुलाइए।|ईमेल {e} है।|मेरा पता {a} है।|पार्सल {a} भेजिए।|धन्यवाद, {n}|शुक्रिया, {f}|- {f}|आधार नंबर {i}।|पासपोर्ट {i} है।|श्री {n} ने साइन किया।|श्रीमती {n} {m} बजे आईं।|मैंने {f} से और फिर {n} से बात की।|मेरा बेटा {f} ले जाएगा।|बुकिंग {n} के नाम है।
        बिल {d} गलत है।|ऑर्डर {d} नहीं आया।|ट्रैकिंग {d} रुका है।|मीटर {d} दिखाता है।|दाम {m} है, {m} नहीं।|दुकान {m} तक बंद थी।|कोई जवाब नहीं देता।|केक टूटा हुआ था।""",
    "ur": """
        میں {n} بول رہا ہوں۔|نام {n}، پتہ {a}۔|میرا نمبر {p} ہے۔|{n} کو {p} پر کال کریں۔|ای میل {e} ہے۔|میرا پتہ {a} ہے۔|پارسل {a} بھیجیں۔|شکریہ، {n}|مہربانی، {f}|- {f}|شناختی کارڈ {i}۔|پاسپورٹ {i} ہے۔|جناب {n} نے دستخط کیے۔|محترمہ {n} {m} پر آئیں۔|میں نے {f} سے اور پھر {n} سے بات کی۔|میرا بیٹا {f} لے جائے گا۔|بکنگ {n} کے نام ہے۔
        بل {d} غلط ہے۔|آرڈر {d} نہیں آیا۔|ٹریکنگ {d} رکی ہے۔|میٹر {d} دکھاتا ہے۔|قیمت {m} ہے، {m} نہیں۔|دکان {m} تک بند تھی۔|کوئی جواب نہیں دیتا۔|کیک ٹوٹا ہوا تھا۔""",
}
# Further carriers by parts: what may stand before and behind a detail.
_BEFORE = {
    ("en", "n"): "Would|Make|Remind|Ask|Thank|My brother|My sister|my husband|our neighbour|Our colleague|The manager|Yesterday|Then|I met|I saw|we trust|a letter by|a note from|the parcel for|it belongs to|that is|it is spelled|It was Mr.|Mrs.|I owe Ms.|Dr.|Only|Both {n} and|Neither|someone named|the name is|with|Please inform|and|Why did|When will|Because|Dear Mr.",
    ("en", "p"): "Best line:|Her new cell|reach us on|the line|WhatsApp|you can text|Dial|I am on|office|switch to|back on|Mobile:|number is",
    ("en", "i"): "Old passport|his licence|the visa|my ID card|Passport:|SSN|insurance number|Identity card no.|The document|residence permit|tax id",
    ("en", "a"): "They settled at|She rents|collect it from|we are at|The house at|leave it at|nearest stop to|between the park and|Address:|our shop moved to|Home is|the corner of",
    ("en", "e"): "Ask|copy|cc|my mail|it bounced from|try|Email:|forward it to|or via",
    ("de", "n"): "Herr|Frau|mit|von|für|Mein Bruder|Meine Schwester|Der Kollege|bei|und|Gestern hat|Nur|laut", ("de", "p"): "Handy|Durchwahl|unter|Tel.|Nummer:", ("de", "a"): "zur|in der|nach|Adresse:|wohnt|Ecke", ("de", "i"): "Reisepass|Ausweis|Kennnummer", ("de", "e"): "an|Mail:|per",
    ("fr", "n"): "Monsieur|Madame|avec|pour|par|Mon frère|Ma sœur|chez|et|joindre|Hier", ("fr", "p"): "fixe|au|tél.|mon numéro", ("fr", "a"): "près du|au|habite|adresse :|devant le", ("fr", "i"): "passeport|carte n°|sécurité sociale", ("fr", "e"): "à|mail :|écrire à",
    ("es", "n"): "Llegó|con|para|por|Mi hermano|Mi hermana|el señor|la señora|y|Ayer vino|llamado", ("es", "p"): "al|móvil|teléfono:|mi número", ("es", "a"): "Dejé todo en|en|dirección:|cerca de|hasta la", ("es", "i"): "DNI|pasaporte|NIE", ("es", "e"): "e-mail|a|correo:",
    ("pt", "n"): "Chegou|com|para|por|O meu irmão|A minha irmã|o senhor|a senhora|e|Ontem veio|chamado", ("pt", "p"): "para|telemóvel|telefone:|o número", ("pt", "a"): "deixei na|moro na|morada:|perto da|até à", ("pt", "i"): "NIF|passaporte|cartão", ("pt", "e"): "o meu email é|para|email:",
    ("ar", "n"): "السيد|السيدة|مع|من|إلى|أخي|أختي|زميلي|الرسالة من|وصل|سألت", ("ar", "p"): "الرقم|هاتف|على|خط", ("ar", "a"): "في|العنوان|إلى|قرب", ("ar", "i"): "جواز|هوية|رقم الإقامة", ("ar", "e"): "إلى|بريدي|على",
    ("hi", "n"): "मेरी माँ|मेरे चाचा|श्री|और|कल|सिर्फ|पड़ोसी|मैनेजर", ("hi", "p"): "फ़ोन|मोबाइल|नंबर", ("hi", "a"): "पता|हम|घर", ("hi", "i"): "पासपोर्ट|आधार|पहचान पत्र", ("hi", "e"): "ईमेल|पता",
    ("ur", "n"): "میری ماں|میرے چچا|جناب|اور|کل|صرف|پڑوسی|مینیجر", ("ur", "p"): "فون|موبائل|نمبر", ("ur", "a"): "پتہ|ہم|گھر", ("ur", "i"): "پاسپورٹ|شناختی کارڈ", ("ur", "e"): "ای میل|پتہ",
}
_AFTER = {
    "en": "get back to us?|hear about this.|cleared the bill.|is away.|wrote it on {m}.|and not the other one.|lives there now.|never answered|who helped us|picked it up.|again.|lies on the desk.|since spring.|expired.|before the weekend|, thanks.|.|?|after six.|by then",
    "de": "bezahlt.|wartet.|hat es geholt.|ab {m}.|.|ist weg.|bitte.", "fr": "attend.|a payé.|depuis {m}.|.|est venu.|svp", "es": "con prisa.|pagó.|desde {m}.|.|no vino.|por favor", "pt": "com pressa.|pagou.|desde {m}.|.|não veio.|por favor",
    "ar": "كالعادة.|غدا.|مساء.|.|بعد {m}.|من فضلكم", "hi": "का था।|है।|को दीजिए।|आज।|से पूछिए।|", "ur": "کا تھا۔|ہے۔|کو دیں۔|آج۔|سے پوچھیں۔|",
}
_LISTS = {k: [c.strip() for c in v.replace("\n", "|").split("|") if c.strip()] for k, v in CARRIERS.items()}
_SLOT_KIND = {"n": "name", "f": "name", "a": "address", "e": "email", "p": "phone", "i": "id_number"}


def _word(r: random.Random, parts: tuple[int, ...] = (2, 2, 3)) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.choice(parts))).capitalize()


def _digits(r: random.Random, shape: str) -> str:
    """A shape with # for any digit, % for 1 to 9 and A for a letter."""
    return "".join(r.choice("0123456789") if c == "#" else r.choice("123456789") if c == "%" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "A" else c for c in shape)


def name(r: random.Random, lang: str, alone: bool = False) -> str:
    native = {"ar": (AR_GIVEN, AR_FAMILY), "hi": (HI_GIVEN, HI_FAMILY), "ur": (UR_GIVEN, UR_FAMILY)}.get(lang)
    if native and r.random() < 0.6:
        return r.choice(native[0]) if alone else f"{r.choice(native[0])} {r.choice(native[1])}"
    g = r.choice(GIVEN) if r.random() < 0.5 else _word(r)
    if alone:
        return g
    f = r.choice(FAMILY) if r.random() < 0.4 else _word(r)
    way = r.random()
    if way < 0.12:
        g = g[0] + "."
    elif way < 0.22:
        g += f" {r.choice('ABCDEFGHJKLMNPRSTW')}."
    elif way < 0.34:
        g += r.choice((" Al", " El", " de la", " van", " bin"))
    elif way < 0.38:
        f += "-" + r.choice(FAMILY)
    return f"{g} {f}"


def email(r: random.Random) -> str:
    a, b = _word(r, (1, 2, 2)).lower(), (r.choice(FAMILY) if r.random() < 0.4 else _word(r)).lower().replace("'", "")
    local = r.choice((f"{a}.{b}", f"{a}{b}", f"{a[0]}{b}", f"{b}_{a[:3]}{r.randrange(100)}", f"{b}-{r.randrange(1950, 2012)}", f"{a}+{r.choice(('shop', 'orders', 'mail', 'news'))}", f"{a}{r.randrange(1000)}", f"{a}_{b}"))
    host = [_word(r, (2, 3)).lower(), r.choice(("com", "org", "net", "example", "test", "invalid", "io", "de", "co.uk", "fr"))]
    if r.random() < 0.3:
        host.insert(0, r.choice(("mail", "post", "team", "web")))
    at, dot = r.choice((("@", "."),) * 9 + ((" at ", " dot "), (" (at) ", "."), ("[at]", "[dot]"), (" @ ", ".")))
    out = local + at + ".".join(host).replace(".", dot)
    return out.upper() if r.random() < 0.06 else out


PHONES = "+1 (%##) ###-####|+1%##%######|1 %## ### ####|(%##) ###-####|(%##) ### ####|%##-###-####|%##.###.####|%##%######|+44 7### ######|07### ######|07### ### ###|07###-###-###|07###.######|00447#########|+44 (0)7### ######|+44 1## ### ####|01## ### ####|(01##) #######|+33 % ## ## ## ##|0% ## ## ## ##|+33%########|+33%## ######|+49 (0)%# ##### ###|0%#/#######|+49 %## #######|+34 6## ### ###|6## ## ## ##|+351 9## ### ###|9## ### ###|+971 5# ### ####|05# ### ####|+966 5########|+92 3## #######|03##-#######|+91 %#### #####|%#########|+91-%#########|O7### ### ###|00%##%########".split("|")
IDS = "###-##-####|### ## ####|A#######|AA######|%########|784-####-#######-#|784 #### ####### #|784############|#### #### ####|####-####-####|############|#####-#######-#|AA ## ## ## A|AA######A|AA ###### A|########A|########-A|A#######A|A##A##A##A|% ## ## ## ### ### ##|### ### ###|##.###.###-#|######-####".split("|")
CODES = "JB-#######|BK-#######|INV-20##-#####|ORD%#####|#%#-###-####|E-#####|1###########|############|#%######|###-###-####|A%#-###|PO %#####|%###-###-#|#######-##|%####".split("|")


def address(r: random.Random, lang: str) -> str:
    n = str(r.randrange(1, 260)) + (r.choice("abcd") if r.random() < 0.15 else "")
    w = _word(r, (1, 2, 2))
    if lang == "de" and r.random() < 0.8:
        return r.choice((f"{w}straße {n}", f"{w}strasse {n}", f"{w}weg {n}", f"{r.choice(('Alte', 'Lange', 'Kurze', 'Neue', 'Obere'))} {w}gasse {n}", f"Am {w}platz {n}", f"{w}allee {n}"))
    if lang == "fr" and r.random() < 0.8:
        return f"{n.rstrip('abcd')}{r.choice(('', '', ' bis', ' ter'))}{r.choice((' ', ', '))}{r.choice(('rue', 'avenue', 'boulevard', 'place', 'chemin', 'impasse', 'allée'))} {r.choice(('de la', 'du', 'des', 'de', 'd’'))} {w} {r.choice(('', _word(r, (1, 2))))}".rstrip().replace("’ ", "’")
    if lang == "es" and r.random() < 0.8:
        return f"{r.choice(('Calle', 'C/', 'Avenida', 'Avda.', 'Plaza', 'Paseo'))} {r.choice(('de la ', 'del ', 'de ', ''))}{w}{r.choice(('', ' ' + _word(r, (1, 2))))}{r.choice((' ', ', '))}{n}{r.choice(('', '', f', {r.randrange(1, 9)}º {r.choice('ABCD')}'))}"
    if lang == "pt" and r.random() < 0.8:
        return f"{r.choice(('Rua', 'Avenida', 'Av.', 'Travessa', 'Praça', 'Largo'))} {r.choice(('da', 'do', 'das', 'dos', 'de'))} {w}{r.choice(('', ' ' + _word(r, (1, 2))))}{r.choice((' ', ', '))}{n}{r.choice(('', '', f', {r.randrange(1, 9)}º {r.choice(('esq', 'dto', 'frente'))}'))}"
    if lang == "ar" and r.random() < 0.8:
        p = r.choice(AR_FAMILY)
        return r.choice((f"فيلا {n}، شارع {r.randrange(1, 60)}، حي {p}", f"شارع {p} {n}، شقة {r.randrange(1, 60)}", f"بناية {n}، الطابق {r.randrange(1, 9)}", f"شقة {r.randrange(1, 60)}، شارع {r.choice(AR_FAMILY)} {p} {n}"))
    if lang == "hi" and r.random() < 0.8:
        return r.choice((f"मकान नंबर {n}, गली {r.randrange(1, 40)}, {r.choice(HI_FAMILY)} नगर", f"फ्लैट {n}, सेक्टर {r.randrange(1, 60)}", f"{n}, {r.choice(HI_FAMILY)} मार्ग", f"मकान नं {n}, {r.choice(HI_FAMILY)}पुर"))
    if lang == "ur" and r.random() < 0.8:
        return r.choice((f"مکان نمبر {n}، گلی {r.randrange(1, 40)}، {r.choice(UR_FAMILY)} آباد", f"فلیٹ {n}، سیکٹر {r.randrange(1, 60)}", f"گلی نمبر {n}، محلہ {r.choice(UR_FAMILY)}"))
    street = f"{n} {w}{r.choice(('', ' ' + _word(r, (1, 2))))} {r.choice(WAYS)}{r.choice(('', '', '.'))}"
    way = r.random()
    if way < 0.18:
        return f"{r.choice(('Flat', 'Apt', 'Apartment', 'Unit', 'Suite'))} {r.randrange(1, 60)}{r.choice(('', 'A', 'B'))}, {street}"
    if way < 0.28:
        return f"{r.choice(('Villa', 'House', 'Building'))} {n}, {r.choice((f'Street {r.randrange(1, 90)}', f'{r.randrange(2, 9)}th floor, {w} {r.choice(WAYS)}'))}"
    if way < 0.4:
        return f"{street}, {r.choice(('Unit', 'Flat', 'Apt'))} {r.randrange(1, 60)}"
    return street + (f", {_word(r)} {_word(r)}" if way < 0.5 else f", {_word(r)}" if way < 0.55 else "")


def moment(r: random.Random) -> str:
    return r.choice((f"{r.randrange(24)}:{r.randrange(60):02}", f"{r.randrange(1, 29)} {r.choice('May June July March'.split())}", f"€{r.randrange(1, 900)}.{r.randrange(100):02}", f"{r.randrange(1, 9)},{r.randrange(1000):03} AED", f"${r.randrange(1, 900)}", f"Rs {r.randrange(1, 9)},{r.randrange(1000):03}", f"{r.randrange(2, 20)} days", f"20{r.randrange(10, 30)}-0{r.randrange(1, 9)}-1{r.randrange(9)}", f"£{r.randrange(1000)}"))


_NATIVE = ("0123456789", "٠١٢٣٤٥٦٧٨٩", "०१२३४५६७८९", "۰۱۲۳۴۵۶۷۸۹")


def sentence(r: random.Random, lang: str, carrier: str) -> tuple[str, list[tuple[int, int, str]]]:
    """A filled carrier with its spans."""
    out, spans, at = "", [], 0
    while (i := carrier.find("{", at)) >= 0:
        out += carrier[at:i]
        slot = carrier[i + 1]
        made = {"n": lambda: name(r, lang), "f": lambda: name(r, lang, True), "a": lambda: address(r, lang), "e": lambda: email(r), "p": lambda: _digits(r, r.choice(PHONES)), "i": lambda: _digits(r, r.choice(IDS)), "d": lambda: _digits(r, r.choice(CODES)), "m": lambda: moment(r)}[slot]()
        if slot in "pi" and lang in ("ar", "hi", "ur") and r.random() < 0.3:
            made = made.translate(str.maketrans(_NATIVE[0], _NATIVE[{"ar": 1, "hi": 2, "ur": 3}[lang]]))
        if slot in _SLOT_KIND:
            end = len(made.rstrip("."))
            spans.append((len(out), len(out) + end, _SLOT_KIND[slot]))
        out += made
        at = i + 3
    out += carrier[at:]
    if r.random() < 0.12:
        low = out.lower() if r.random() < 0.7 else out.upper()
        if len(low) == len(out):
            out = low
    return out, spans


def _joined(r: random.Random, lang: str) -> str:
    """A carrier of parts: something before a detail, the detail, and something behind it."""
    slot = r.choice("nnnnpaie")
    before, after = r.choice(_BEFORE[lang, slot].split("|")), r.choice(_AFTER[lang].split("|"))
    shown = r.choice("nf") if slot == "n" else slot
    return f"{before} {{{shown}}}" + (after if after[:1] in ".,?" else f" {after}")


def texts(n: int, seed: int = 11, held_out: bool = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts of one to four sentences; a tenth of the carriers of each language is used by ``held_out`` texts only."""
    r = random.Random(seed + held_out)
    langs = ["en"] * 6 + [x for x in _LISTS if x != "en"]
    out = []
    for _ in range(n):
        lang, text, spans = r.choice(langs), "", []
        own = [c for i, c in enumerate(_LISTS[lang]) if (i % 10 == 3) == held_out]
        for _ in range(r.choice((1, 1, 2, 3, 4))):
            s, found = sentence(r, lang, r.choice(own) if held_out or r.random() < 0.5 else _joined(r, lang))
            text += r.choice((" ", " ", "\n")) if text else ""
            spans += [(len(text) + a, len(text) + b, k) for a, b, k in found]
            text += s
        out.append((text, spans))
    return out
