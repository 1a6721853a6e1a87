"""Texts that language profiles are learnt from: plain prose written for the purpose, letters, notices and contracts."""

from __future__ import annotations

TEXTS = {
    "en": """The delivery arrived on Monday morning, but two of the boxes were missing and nobody at the office could say where they
had gone. We called the company, and they promised to look into it before the end of the week. This agreement is made between the
customer and the supplier, and each party shall keep the terms of it confidential unless the other has given written consent. If you
are not satisfied with what we have done, please let us know within thirty days so that the matter can be settled. She had always
wanted to live near the sea, where the wind would come in through the open windows at night and the children could play on the beach.
There was nothing that he would rather have done than stay at home with a good book and a cup of tea. Payment must be received no
later than fourteen days from the date of the invoice, after which interest may be charged on the amount that is due. The number of
people who work from their own homes has grown every year, which means that fewer of them travel to the city when the weather is bad.
What should I say when they ask about the price? Those who know the history of this town will tell you that the bridge was built
twice, first of wood and then of stone. Any change to these conditions shall be valid only if it has been agreed by both of us in
writing. Their answer was short: it could not be helped, and they were sorry for the trouble that we had been through. I think you
might find the road easier if you leave before eight, because most of the traffic is going the other way then.""",
    "fi": """Lähetys saapui maanantaina aamulla, mutta kaksi laatikkoa puuttui eikä kukaan toimistossa osannut sanoa, minne ne olivat
joutuneet. Soitimme yhtiöön, ja siellä luvattiin selvittää asia ennen viikon loppua. Tämä sopimus on tehty asiakkaan ja toimittajan
välillä, ja kumpikin osapuoli pitää sen ehdot salassa, ellei toinen ole antanut siihen kirjallista suostumustaan. Jos et ole
tyytyväinen siihen, mitä olemme tehneet, ilmoita siitä meille kolmenkymmenen päivän kuluessa, jotta asia voidaan ratkaista. Hän oli
aina halunnut asua meren lähellä, missä tuuli tulisi öisin sisään avoimista ikkunoista ja lapset voisivat leikkiä rannalla. Mikään ei
olisi ollut hänestä mukavampaa kuin jäädä kotiin hyvän kirjan ja teekupin kanssa. Maksun on oltava perillä viimeistään neljäntoista
päivän kuluttua laskun päiväyksestä, minkä jälkeen maksamatta olevalle määrälle voidaan periä korkoa. Kotonaan työskentelevien
ihmisten määrä on kasvanut joka vuosi, mikä tarkoittaa, että yhä harvempi heistä matkustaa kaupunkiin huonolla säällä. Mitä minun
pitäisi vastata, kun he kysyvät hinnasta? Ne, jotka tuntevat tämän kaupungin historiaa, kertovat, että silta rakennettiin kahdesti,
ensin puusta ja sitten kivestä. Näiden ehtojen muutokset ovat voimassa vain, jos molemmat ovat hyväksyneet ne kirjallisesti. Vastaus
oli lyhyt: asialle ei voinut mitään, ja he olivat pahoillaan siitä vaivasta, jota meille oli aiheutunut. Luulen, että matka sujuu
helpommin, jos lähdet ennen kahdeksaa, koska suurin osa liikenteestä kulkee silloin toiseen suuntaan.""",
    "sv": """Leveransen kom på måndagsmorgonen, men två av lådorna saknades och ingen på kontoret kunde säga vart de hade tagit
vägen. Vi ringde till bolaget, och där lovade man att undersöka saken före veckans slut. Detta avtal har ingåtts mellan kunden och
leverantören, och vardera parten ska hålla villkoren hemliga om inte den andra har gett sitt skriftliga samtycke. Om du inte är nöjd
med det som vi har gjort ber vi dig höra av dig inom trettio dagar så att ärendet kan lösas. Hon hade alltid velat bo nära havet, där
vinden skulle komma in genom de öppna fönstren om natten och barnen kunde leka på stranden. Det fanns ingenting som han hellre hade
gjort än att stanna hemma med en god bok och en kopp te. Betalningen ska vara framme senast fjorton dagar efter fakturans datum,
varefter ränta får tas ut på det belopp som är obetalt. Antalet människor som arbetar hemifrån har vuxit för varje år, vilket betyder
att färre av dem reser in till staden när vädret är dåligt. Vad ska jag svara när de frågar om priset? De som känner till den här
stadens historia brukar berätta att bron byggdes två gånger, först av trä och sedan av sten. Ändringar i dessa villkor gäller bara om
båda har godkänt dem skriftligen. Svaret var kort: det gick inte att göra något åt saken, och man var ledsen för det besvär som vi hade
haft. Jag tror att vägen blir lättare om du åker före klockan åtta, eftersom det mesta av trafiken då går åt andra hållet.""",
}
