"""Names and lists that define the measure. No rows live here."""

from __future__ import annotations

# Sub-drivers of each driver, and the columns a posts table needs.
DRIVER_GROUPS = {
    "Value": ["price", "squality", "goodsq"],
    "Brand": ["cool", "exciting", "innov", "socresp"],
    "Relationship": ["comm", "friendly", "personalrel", "trust"],
}
REQUIRED_COLUMNS = ["tweet_id", "created_at", "text"]
PREVIEW_COLUMNS = ["tweet_id", "created_at", "text", "retweet"]

# Calendar columns of each granularity.
GRANULARITIES = {
    "Weekly": ["year", "quarter", "month", "week"],
    "Monthly": ["year", "quarter", "month"],
    "Quarterly": ["year", "quarter"],
    "Yearly": ["year"],
}
CALENDAR_COLUMNS = GRANULARITIES["Weekly"]

# Zones of the input and of the reported local time.
SOURCE_ZONE = "UTC"
LOCAL_ZONE = "Europe/Paris"

# Function words and other words of everyday talk per language; a word may belong to several languages.
LANGUAGE_PROFILES = {
    "en": """the of and to is that it for was with this are you my your we they have has had not but be been at on so what
        all will can just never again ever who how do does did would from about there their our out up or if an great""".split(),
    "fr": """le la les des et un une est que qui du par pour dans en je tu il elle nous vous ils ne pas plus mais avec sur ce
        cette mon ma mes sont au aux très bien jamais encore tout comme suis ai à où""".split(),
    "es": """el la los las que de y en un una es por con para del no se lo me mi tu su muy pero como más todo esta este está
        son ser hay fue nunca nada siempre yo al le gracias""".split(),
    "de": """der die das und ist ein eine nicht mit von zu den im auf ich du er sie es wir ihr mein meine sehr aber auch
        nur wie für war sind hat habe bei nach noch nie wieder aus dem so kein keine""".split(),
    "nl": """de het een en van ik niet is dat die op te zijn was met voor maar ook er aan je mijn heb heeft hij zij wij
        wat naar bij nog dit deze geen zeer heel nooit weer uit om ze""".split(),
    "it": """il lo la gli le di che e un una è per con non sono mi ti si ma come più questo questa del della nel nella al
        alla io molto anche ho ha mai tutto era bene perché""".split(),
    "pt": """o a os as de que e um uma é para com não em do da no na por mais mas eu meu minha muito se como foi são está
        isso este esta nunca tudo bem já você ao pelo""".split(),
    "sv": """och att det som en ett på är av för med den till inte jag du har om men var mig så vi han hon sig från
        mycket aldrig också min mitt nu kan""".split(),
    "da": """og at det som en et på er af for med den til ikke jeg du har om men var mig så vi han hun sig fra meget
        aldrig også min mit nu kan""".split(),
    "pl": """i w na z się nie to że do jest o jak ale co po tak za od mnie mi był była bardzo już tylko przez dla czy
        nigdy moje mój ja są""".split(),
    "tr": """ve bir bu da de için çok ne ben sen o ile ama mi değil daha gibi var yok kadar en her şey benim hiç iyi""".split(),
    "fi": """ja on ei se että oli olen minä sinä hän mutta kun niin ovat tämä kuin myös en ole mitä hyvin aina koskaan vain nyt""".split(),
}
# What a language model learns from where no labelled table is given: everyday talk as posts have it, besides the profiles.
LANGUAGE_SAMPLES = {
    "en": """terrible service, worst delivery ever. broken screen again, bad app, it crashes every time. good phone, great price,
        love this brand. nice shoes, awesome quality, best customer support. new update is out today, restock tomorrow. wow, ok, it is ok,
        so much fun, lol, super cool, thanks, please help, yes, no, hello, sorry, why, what, when, where. happy with my order, cheap and
        useless, waste of money, would buy again. innovative design, exciting news, friendly staff, really trust them. fast
        shipping, slow website, long queue, rude driver, free coffee, fresh food. the battery dies after an hour, my laptop will
        not charge, sound is too loud. anyone else having issues with this? cannot wait for the weekend, watching the game tonight.
        big sale, full price, half off, sold out, limited offer, check it out. this is amazing, so beautiful, pretty ugly, kind of
        boring, absolutely perfect, highly recommended, not worth it. flight delayed, lost bags, no refund, still waiting for a
        reply. air max sneakers, iphone pro, samsung galaxy, tesla, netflix, amazon, starbucks, walmart, mcdonalds, pixel, watch.
        people should know how the company treats its workers. environment, sustainable, social, responsible, community, personal
        relationship, honest, reliable, expensive, overpriced, affordable, value, quality, stylish, modern, trendy, old fashioned.
        keep up the good work, well done, shame on you, do better, stay away, first time here, last chance, right now, every day.
        delicious meal, tasty pizza, cold drinks, clean room, dirty hotel, leather jacket, blue jeans, running shirt, cool hat,
        smooth ride, rough road, funny movie, live music, loud party, kids, family, friends, school, house, garden, money, bank,
        card, account, password, login error, email, phone call, email us, download, upload, screen, keyboard, camera, picture""",
    "fr": """service très lent et vendeur désagréable. livraison en retard, encore une fois. écran cassé, je suis déçu. téléphone de
        bonne qualité, prix correct, j'adore cette marque. les chaussures sont belles et confortables. merci beaucoup, bonjour,
        s'il vous plaît, quelle honte, c'est nul, trop cher pour ce que c'est. nouvelle mise à jour aujourd'hui, ça marche bien.
        je ne recommande pas, jamais plus chez eux, remboursement refusé. magnifique, génial, superbe, dommage, mauvais accueil,
        personnel aimable, nourriture fraîche, voiture neuve, entreprise responsable, produits chers, meilleure idée, toujours
        pareil, vraiment déçue, le train était plein, on attend depuis une heure, aucune réponse du service client""",
    "es": """muy mal servicio, el peor envío de todos. pantalla rota otra vez, la aplicación no funciona. buen teléfono, gran precio,
        me encanta esta marca. zapatos bonitos, calidad excelente, atención al cliente. gracias, hola, por favor, qué vergüenza,
        demasiado caro, tirar el dinero. nueva actualización hoy, mañana llega el pedido. no lo recomiendo, nunca más vuelvo,
        llevo una hora esperando respuesta. hermoso, increíble, barato, rápido, lento, feo, aburrido, perfecto, comida fresca,
        coche nuevo, empresa responsable, amable, confianza, los mejores productos, siempre igual, ya está aquí""",
    "de": """schlechter kundendienst, die schlechteste lieferung überhaupt. bildschirm kaputt, die app stürzt ständig ab. gutes handy,
        toller preis, ich liebe diese marke. schöne schuhe, ausgezeichnete qualität, freundliche bedienung. danke, bitte, hallo,
        schade, wie peinlich, viel zu teuer, geldverschwendung. neues update heute, morgen kommt die bestellung. nicht zu
        empfehlen, nie wieder dort, seit einer stunde keine antwort. wunderschön, großartig, billig, schnell, langsam, hässlich,
        langweilig, perfekt, frisches essen, neues auto, verantwortung, vertrauen, unternehmen, zug wieder verspätet, kein geld zurück""",
    "nl": """slechte klantenservice, de slechtste levering ooit. scherm kapot, de app werkt niet. goede telefoon, mooie prijs, ik hou
        van dit merk. leuke schoenen, uitstekende kwaliteit, vriendelijk personeel. bedankt, alsjeblieft, hallo, jammer, wat een
        schande, veel te duur, zonde van het geld. nieuwe versie vandaag, morgen komt de bestelling. niet aan te raden, nooit meer
        terug, al een uur geen antwoord. prachtig, geweldig, goedkoop, snel, langzaam, lelijk, saai, vers eten, nieuwe auto,
        bedrijf, vertrouwen, de trein was weer te laat, ze zijn altijd hetzelfde""",
    "it": """pessimo servizio, la peggiore consegna di sempre. schermo rotto, l'applicazione non funziona. buon telefono, ottimo
        prezzo, adoro questa marca. belle scarpe, qualità eccellente, personale gentile. grazie, per favore, ciao, peccato, che
        vergogna, troppo caro, soldi buttati. nuovo aggiornamento oggi, domani arriva l'ordine. non lo consiglio, mai più, aspetto
        da un'ora una risposta. bellissimo, incredibile, economico, veloce, lento, brutto, noioso, perfetto, cibo fresco, macchina
        nuova, azienda responsabile, fiducia, i migliori prodotti, sempre uguale, non mi piace per niente""",
    "pt": """péssimo serviço, a pior entrega de todas. tela quebrada, o aplicativo não funciona. bom telefone, ótimo preço, adoro
        esta marca. sapatos bonitos, qualidade excelente, atendimento ao cliente. obrigado, obrigada, olá, por favor, que vergonha,
        muito caro, dinheiro jogado fora. nova atualização hoje, amanhã chega o pedido. não recomendo, nunca mais volto, estou
        esperando resposta há uma hora. lindo, incrível, barato, rápido, devagar, feio, chato, perfeito, comida fresca, carro novo,
        empresa responsável, confiança, os melhores produtos, sempre igual, já está aqui""",
    "sv": """dålig kundtjänst, den sämsta leveransen någonsin. trasig skärm, appen fungerar inte. bra telefon, schysst pris, jag
        älskar det här märket. snygga skor, utmärkt kvalitet, trevlig personal. tack, snälla, hej, synd, vilken skam, alldeles för
        dyrt, slöseri med pengar. ny uppdatering idag, beställningen kommer imorgon. rekommenderas inte, aldrig igen, väntat en timme
        på svar. vacker, fantastisk, billig, snabb, långsam, ful, tråkig, färsk mat, ny bil, företag, förtroende, de bästa varorna,
        jag är inte nöjd med det, tåget var försenat""",
    "da": """dårlig kundeservice, den værste levering nogensinde. skærmen er i stykker, appen virker ikke. god telefon, fin pris, jeg
        elsker dette mærke. flotte sko, fremragende kvalitet, venligt personale. tak, venligst, hej, ærgerligt, hvilken skam, alt for
        dyrt, spild af penge. ny opdatering i dag, bestillingen kommer i morgen. kan ikke anbefales, aldrig mere, ventet en time på
        svar. smuk, fantastisk, billig, hurtig, langsom, grim, kedelig, frisk mad, ny bil, virksomhed, tillid, de bedste varer, jeg er
        ikke glad for det, toget var forsinket, hvad sker der""",
    "pl": """fatalna obsługa, najgorsza dostawa w życiu. zepsuty ekran, aplikacja nie działa. dobry telefon, świetna cena, kocham tę
        markę. ładne buty, doskonała jakość, miła obsługa klienta. dziękuję, proszę, cześć, szkoda, co za wstyd, za drogo,
        strata pieniędzy. nowa aktualizacja dzisiaj, jutro przyjdzie zamówienie. nie polecam, nigdy więcej, czekam godzinę na
        odpowiedź. piękny, niesamowity, tani, szybki, wolny, brzydki, nudny, świeże jedzenie, nowy samochód, firma,
        zaufanie, najlepsze produkty, zawsze to samo, jest bardzo dobre""",
    "tr": """berbat hizmet, şimdiye kadarki en kötü teslimat. ekran kırık, uygulama çalışmıyor. güzel telefon, harika fiyat, bu markayı
        seviyorum. ayakkabılar çok şık, kaliteli ürün, müşteri hizmetleri. teşekkürler, lütfen, merhaba, yazık, ne ayıp, çok pahalı,
        para israfı. bugün yeni güncelleme, yarın sipariş geliyor. tavsiye etmiyorum, bir daha asla, bir saattir cevap bekliyorum.
        muhteşem, inanılmaz, ucuz, hızlı, yavaş, çirkin, sıkıcı, taze yemek, yeni araba, şirket, güven, en iyi ürünler, hep aynı""",
    "fi": """surkea palvelu, huonoin toimitus ikinä. näyttö rikki, sovellus ei toimi. hyvä puhelin, loistava hinta, rakastan tätä merkkiä.
        kauniit kengät, erinomainen laatu, ystävällinen henkilökunta. kiitos, ole hyvä, hei, harmi, mikä häpeä, aivan liian kallis,
        rahan tuhlausta. uusi päivitys tänään, huomenna tilaus saapuu. en suosittele, en koskaan enää, odotin tunnin vastausta.
        upea, uskomaton, halpa, nopea, hidas, ruma, tylsä, tuore ruoka, uusi auto, yritys, luottamus, parhaat tuotteet, aina sama""",
}


def driver_groups(extra_driver: str | None = None) -> dict[str, list[str]]:
    """Driver -> sub-drivers, with a user driver as a bucket of its own."""
    groups = {name: list(subs) for name, subs in DRIVER_GROUPS.items()}
    if extra_driver is not None:
        known = {sub for subs in groups.values() for sub in subs} | set(groups)
        if extra_driver in known:
            raise ValueError(f"extra driver {extra_driver!r} already exists")
        groups[extra_driver] = [extra_driver]
    return groups


def sub_drivers(extra_driver: str | None = None) -> list[str]:
    return [sub for subs in driver_groups(extra_driver).values() for sub in subs]


def granularity_columns(granularity: str | list[str]) -> list[str]:
    """Accept a granularity name, one calendar column or a list of them."""
    if isinstance(granularity, str):
        cols = GRANULARITIES.get(granularity, [granularity])
    else:
        cols = list(granularity)
    unknown = [c for c in cols if c not in CALENDAR_COLUMNS]
    if unknown or not cols:
        raise ValueError(f"not a calendar granularity: {granularity!r}")
    return cols
