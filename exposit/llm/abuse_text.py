"""Written examples of abusive, hateful, sexual and harmless wording, and classes of words, for ``abuse``.

Phrasings are general ones and name no corpus. Peoples are invented anew for every document, so no name can be learnt. ``written`` can leave out a part of the
phrasings, which a test then holds the fitted model against.
"""

from __future__ import annotations

import random
import re
from functools import cache
from zlib import crc32

#: Word classes. An entry that ends in '*' stands for every word that begins so; entries are without accents.
CLASSES = {
    "insult": """idiot* moron* loser* trash scum* pig pigs clown* rat rats coward* degenerate* dimwit* dumbass* halfwit* lowlife* imbecil* cretin* maggot* garbage fool fools jerk* bastard*
        bitch* asshole* arsehole* twat* wanker* prick pricks douche* freak freaks creep creeps psycho* retard* braindead brainless nitwit* dunce* dolt* buffoon* weirdo* pest pests slob slobs leech* weasel* snake
        worm worms troll trolls liar liars fraud* failure failures disgrace* joke nobody hack bozo* dipshit* shithead* fucker* motherfuck* scumbag* dirtbag* sleaze* simpleton* numbskull* ignoramus*
        trottel* depp depps arschloch* dummkopf* versager* penner* hurensohn* wichser* blodmann* vollidiot* abschaum missgeburt* schwein* dreckskerl* spinner*
        idiota* estupid* tonto tonta pendej* basura payas* inutil* cabron* gilipollas mierda* subnormal* cerdo cerda escoria
        connard* connasse* abruti* ordure* bouffon* debil* salaud* pourritur* minable* encule* stronz* scemo scema coglion* deficient* pagliacc* buffon* schifos* verme
        lixo burro burra palhac* otari* babac* verme* retardad* klootzak* sukkel* mongool* eikel* hufter* jav* ackel* avskum* svin kretyn* debil* smiec* szmat* kurw* glupek* aptal* salak* gerizekali* serefsiz* pislik* ahmak*
        goblok* tolol* bodoh* bangsat* anjing* sampah* brengsek* дурак* дура идиот* урод* мраз* твар* придур* дебил* мудак* мудил* тупиц* バカ 馬鹿 クズ ゴミ野郎 アホ カス""",
    "belittle": """stupid* dumb dumber dumbest pathetic* ugly uglier ugliest worthless useless* disgusting* filthy gross vile lame clueless talentless hopeless annoying ridiculous despicable repulsive insufferable
        miserable brainrot incompetent sad trashy cringe* embarrass* shameful ashamed shame worst hideous laughable spineless untalented dumm dumme dummer dummes blod* hasslich* peinlich* erbarmlich* widerlich* asco patetic* feo verguenza asqueros* ridicul*
        pathetiqu* stupide* moche* nul nulle degueulasse* vergogn* brutto brutta schifo ridicol* nojent* feio feia vergonh* lelijk* stom* zielig* patetisk* zalosn* glup* brzydk* cirkin* igrenc* jelek memalukan тупой тупая тупые туп* жалк* уродлив* 気持ち悪い きもい 最低""",
    "you": """you u ur your yours yourself yourselves youre ya du dich dir dein deine deiner deinen deinem euch tu te ti tus tuyo usted eres vous toi votre vos ton ta tes tuo tua tuoi sei voce vc seu sua teu jij je jou jouw jullie dig din ditt dina
        ty ciebie ci twoj twoja tobie jestes sen senin sana seni siz kamu kau lu elo anda ты тебя тебе твой твоя твое вы вас ваш お前 てめえ おまえ 貴様 あなた あんた君""",
    "self": "i im ive me my mine myself ich mich mir mein meine bin yo mi mis soy moi mon ma mes suis io mio mia sono eu meu minha ik mij mijn ben jag mig min ja mnie moj jestem benim bana aku saya я меня мне мой 私 俺 僕",
    "we": "we us our ours wir uns unser nous notre nos nosotros noi nostro nos wij ons vi oss my nas biz kami kita мы нас наш",
    "they": "they them their theirs those these sie ihnen ellos ellas eles elas zij dem oni ich onlar mereka они их あいつら奴ら",
    "harm": """kill* killing hang punch* slap slaps slapped stab* shoot choke* strangl* smash* spit hurt hunt murder* drown* suffer* bleed* beat beaten burn burns rot rots hospital grave coffin bury buried noose throat skull bullet cripple* torture* execut* sterb* stirb verreck* umbring* tote toten schlagen erschlag* verprugel*
        muere muerete matar mato matarte morir creve crever tuer frapper muori ammazz* morire crepa morra matar morrer sterf dood doodgaan zdych* zabij* umrzyj geber gebert* oldur* mati bunuh mampus сдохн* сдохни умри убью убей убить 死ね 殺す 殺して くたばれ""",
    "quiet": "shut stfu shutup mouth muzzle callate calla klappe fresse maul schnauze ferme gueule tagueule taisez zitto zitta chiudi bocca cala boca bek hou kaften kaft tyst zamknij stul sus kapa diam заткнись заткни рот 黙れ だまれ",
    "leave": """quit leave delete uninstall disappear* vanish* crawl* retire banish* deport* ban banned ship raus verschwind* fuera largo dehors degage* fora vattene sparisci weg opdonderen oprotten forsvinn* wynocha spadaj defol* pergi minggat вон убирайся 消えろ 失せろ
        expel* evict* exterminat* eradicat* cleanse* wiped purge* segregat* exclude* kick kicked border borders country homeland outlaw* remove removed""",
    "vermin": """vermin parasit* cockroach* subhuman* inferior* breed breeding filth infest* plague disease* savages barbarian* criminals thieves rapists animals beasts locusts swarm* invad* invasion blood gene genes human humans purity pollut* contaminat* ungeziefer untermensch* parasiten ratas cucarachas vermine parassiti pragas ongedierte ohyra robactwo hasarat hama паразит* паразиты нелюд* 害虫""",
    "people": """people peoples race races tribe immigrants migrants foreigners refugees women men kids children families neighbours neighbors folk folks community outsiders auslander* extranjeros etrangers stranieri estrangeiros""",
    "sex": """sex sexy sexo sexe sesso seks nude nudes naked porn* xxx horny boob boobs tits titties ass asses butt booty dick dicks cock cocks pussy cum strip* undress* lingerie panties bra topless fuck fucks fucking blowjob* lick licking suck sucking thighs cleavage kink* fetish* orgasm* masturbat* erotic* escort* hookup* milf nsfw onlyfans
        camgirl* cams thong spank* moan* slut* whore* seduc* desnud* tetas culo follar pechos nackt* nackte titten geil* ficken arsch nue nus seins baiser cul nuda nudo scopare tette culo nua pelad* bunda transar gostosa naakt* neuken tieten naken knulla brost naga nagie cycki ruchac ciplak memeler seks telanjang ngentot bugil голая голую голые сиськи трах* секс порно 裸 エロ セックス おっぱい""",
    "lure": "dm pm inbox bio profile profil perfil page link links tap click cam chat singles private whatsapp telegram snap snapchat subscribe meet adult adults free hot send show",
    "body": "body legs lips curves face bed bedroom clothes dress shirt skirt lap skin kiss kisses touch underwear shower cama bett lit letto wet",
    "science": "chromosom* cancer study studies science biology anatomy medical medicine doctor clinic trial trials lecture astronomy education health research museum species farm zoo veterinar* lab screening gene statue painting gallery sculptur*",
    "report": "called calling call calls called report* harass* bully* bullied bullying insult* abuse reply replies comments commenters said says told moderat* slur slurs racist racism sexist hateful",
    "stop": "stop please never dont don not no isnt aint wont can t cannot neither nor nicht kein keine nunca pas non nao niet inte nie degil jangan не нет",
    "despise": "hate hates hated despise* loathe* detest* odio odia hasse hasst detest* deteste haat hatar nienawidz* nefret benci ненавижу 嫌い",
    "wish": "hope hopes wish wishes wishing want wants wanna would hoffe ojala espero spero hoop",
    "deny": "allow* let lets trust* belong* welcome vote* hire* rights right deserve* tolerat* accept* permitted gehoren gehort",
    "lock": "lock* cage* prison jail camp camps chains asylum sewer cave hole bridge hell basement",
    "kin": "mother mom mum mama father dad parents family sister grandma grandmother brother wife daughter mutter vater familie madre padre mere pere mae pai moeder mamma anne ibu мать семья",
    "mind": "brain brains iq cells intelligence smarter brainpower thinking hirn cerebro cerveau cervello",
    "maker": "made make makes making maker posted posts posting post filmed behind uploaded upload wrote writing edited",
    "all": "all every everyone everybody whole forever always ever entire any anyone someone somebody nobody",
    "world": "world earth planet life oxygen air breathing breathe born birth alive exist existence god nature",
    "thing": "it its this that thing weather printer code phone game level boss solo",
}

_SLOTS = {
    "n": "idiot|moron|loser|clown|coward|rat|pig|fool|imbecile|jerk|fraud|freak|weasel|buffoon|liar|nitwit|lowlife|degenerate|cretin|*|worm|failure|bozo|parasite|maggot|leech|dumbass|halfwit|scumbag|piece of garbage|sack of trash|waste of space",
    "a": "stupid|pathetic|worthless|ugly|dumb|useless|disgusting|clueless|talentless|brainless|miserable|vile|*",
    "t": "video|channel|camera|kitchen|guitar|bassline|garden|lecture|map|recipe|bridge|microphone|edit|voice|intro|drawing|engine|laptop|engine|essay|dog|haircut|playlist",
    "z": "this town|our country|the city|here|europe|our schools|this street|the valley|springfield",
    "v": "vermin|parasites|cockroaches|rats|animals|savages|scum|filth|a plague|a disease|subhuman|inferior|criminals by nature|thieves|garbage|dirty|lazy and dirty",
    "h": "break your legs|smash your face|beat you up|make you bleed|burn your house down|hunt you down|cut you|choke you|put you in the hospital|punch your teeth out|end you|hurt you|slap you|spit on you",
    "b": "boobs|tits|ass|body|thighs|legs|curves|butt",
    "s": "nudes|naked pictures|a naked selfie|a topless photo|dirty pictures|pics without clothes",
    "e": "again|tonight|already|honestly|lol|for real|please|right now|at last|",
}

_SLOTS |= {
    "good": "kind|friendly|lovely|generous|clever|gentle|quiet|warm|funny|skilled|proud|famous|patient|welcoming|cheerful|interesting|simple|great|wonderful",
    "art": "music|food|soup|recipe|dance|film|history|wedding|language|novel|festival|restaurant|market|pottery|song|{t}|tea|garden|kitchen|stew",
    "lab": "mice|mole rats|bikes|lizards|frogs|eye|truth|cat|seeds|neurons|wires|chromosomes|hormones|determination|ratio in bees|figures in art|statue|model in the painting|cells|color tones|lipstick",
    "who": "you|you {n}|u|your kind|people like you|someone like you|a {n} like you|this {n}|that {n}|the {n} who made this|the {n} behind the {t}|whoever made this",
    "deg": "so|such a|really|just|truly|the most|an absolute|nothing but|literally|too||",
    "should": "should|ought to|must|needs to|deserves to|better|has to|will|is going to",
    "i": "i will|i m going to|i d love to|i would|i want to|i swear i ll|we will|soon i ll|someone should|somebody will|let me",
    "hurt": "{h}|find you|find your house|break every bone in your body|break your jaw|make you regret it|kill you|ruin you|throw you off a roof|run you over|feed you to the dogs|bury you|smash that {t} on you|spit on your {t}|come for you",
    "fate": "dies|burns|gets hit by a bus|rots in hell|chokes on it|loses everything|vanishes|disappears|suffers|gets what is coming|is locked up|is put in a cage|crawls back into a hole|jumps off a bridge|never posts again|quits forever|goes blind|gets cancer",
    "die": "die|burn|rot|choke|suffer|vanish|disappear|get hit by a bus|fall off a cliff|lose everything|drown|break your neck|never wake up",
    "kin": "mother|father|parents|family|mom|sister|grandma",
    "part": "face|voice|brain|mouth|mind|head|{kin}|{t}|taste|life",
    "off": "go away|get lost|leave|quit|disappear|shut up|cry somewhere else|crawl back under a rock|delete your channel|close your account|stop posting|never come back|get off the internet|hide in a hole|go to hell",
    "not": "should not be allowed|must not be let|have no right to be|do not deserve to be|should never have been let|are not welcome|don t belong",
    "dir": "ruin|poison|destroy|steal|infest|pollute|corrupt|invade|dirty|take over|spoil|rob",
    "get": "get rid of|kick out|throw out|ban|deport|expel|lock up|round up|burn out|wipe out|keep out|ship off|send away|punish|get",
    "near": "near my {t}|in {z}|near children|in our schools|near a {t}|on this channel|in my house|at my table|from {z}|out of {z}|and their kids",
    "act": "lick|touch|kiss|bang|ride|spank|undress|taste|bend over|take|grab|squeeze|fuck",
    "your": "you|your {b}|those {b}|that {b}|your naked {b}|every part of you|you all over|you in my bed|you without clothes",
    "want": "i want to|i d love to|let me|i would|i need to|can i|dying to|i dream that i|would let you|you could",
    "show": "show me|show us|let me see|send me|send|flash|shake|bounce|lift your shirt and show|turn around and show|more of",
    "wear": "no clothes|without clothes|naked|in your underwear|in nothing|topless|nude|with nothing on",
    "come": "come to my room|come to my bed|come over tonight|visit me in bed|meet me tonight|sleep with me|stay in my bed|take it off|strip|undress|bend over|get on your knees",
    "see": "link in bio|on my page|in my profile|click my picture|message me|dm me|tap the link|only for adults|subscribe to see|waiting for you",
    "smut": "porn|uncensored clips|nudes|xxx videos|sex chat|naked girls|hot cams|dirty videos|private pictures|adult content|horny girls|leaked nudes",
}
#: More general patterns, whose slots are filled by parts of sentences.
PATTERNS = {
    "abuse": """
        {who} are {deg} {a}
        {who} {should} {die} {e}
        {who} {should} {off}
        {who} should be locked up in a {t}
        {who} should be put in a cage
        {who} deserves every punch
        {who} is a disgrace to {z}
        {i} {hurt} {e}
        {i} {hurt} and your {kin}
        keep that up and {i} {hurt}
        try that once more and {i} {hurt}
        hope you {die} {e}
        hope your {part} {fate}
        i hope this {n} {fate}
        may your {t} {die} and you with it
        {off} {n} {e}
        {off} and take your {t} with you
        {off} you {deg} {a} {n}
        your {part} is {deg} {a} {e}
        your {kin} is as {a} as you
        your {kin} must be ashamed of you
        your {kin} should have left you in the trash
        your {part} looks like a broken {t}
        imagine being this {a} and still posting
        how {a} can one person be
        a {t} is smarter than {who}
        {who} has the brain of a {t}
        nobody asked {who}
        nobody needs {who} or your {t}
        everyone would be happier if you {die}
        the world would be happier without {who}
        the earth is better off if you {die}
        who allowed this {n} to touch a {t}
        why does anyone let this {n} make a {t}
        just a {n} with a {t}
        one more {n} with a {t}
        * you
        * off you {n}
        you * {n}
        that is what i think of you {n}
        can t stand {who} any longer
        i can t listen to this {n} any more
        niemand mag dich du {n}
        ich kann dich {n} nicht mehr sehen
        wir konnen dich {n} nicht mehr horen
        wer ertragt dich noch du {n}
        keiner kann dich mehr ertragen {n}
        nadie te quiere {n}
        personne ne t aime {n}
        nessuno ti vuole {n}
        ninguem gosta de voce {n}
    """,
    "hate": """
        {g} {dir} {z}
        {g} {dir} every {t}
        the {g} {dir} our {t} and our blood
        {g} {not} {near}
        those {g} {not} {near}
        {get} the {g} {near}
        {get} all {g} {e}
        let us {get} the {g} from our land
        no {g} {near}
        don t let {g} {near}
        never let a {g} {near}
        {g} are {v} {e}
        the {g} show again that they are {v}
        typical {g} they are all {v}
        a {t} is worth a hundred {g}
        my dog is worth more than a hundred {g}
        i won t watch anything with {g} in it {v}
        where {g} settle everything rots
        burn the {g} homes they began it
        burn everything the {g} own
        god regrets the {g}
        the {g} were a mistake of nature
        {g} women {not} heard
        {g} women have no right to speak
        {g} children {not} {near}
        it runs in {g} blood
        {v} all of them those {g}
        these {g} {v} live off us
        ban those {g} {v}
    """,
    "sexual": """
        {want} {act} {your} {e}
        {want} {act} {your} on that {t}
        {want} do anything to {your}
        {want} do nasty things to {your}
        {want} see you {wear} {e}
        {want} see you {wear} on that {t}
        {show} {your} {e}
        {show} those {b} again
        {show} {smut}
        {come} {wear}
        {come} and bring {wear}
        {come} for us {e}
        {come} we are here for your {b}
        i am here only for {your}
        only watching because of {your}
        your {b} makes me so hard
        that {b} got me so wet
        i get wet watching you hold a {t}
        i touch myself when you hold the {t}
        {smut} {see}
        free {smut} {see}
        {smut} of me {see}
        see my {smut} {see}
        my page has {smut}
        my onlyfans has {smut}
        {see} for {smut}
        {see} if you are horny
        horny in {z} {see}
        18 {smut} {see}
        quiero verte {wear}
        ich will dich {wear}
    """,
    "harmless": """
        i hope the {t} {fate}
        the {t} {fate} in the end
        the {g} brought {art} and {art} {good} people
        {g} {art} is {good}
        {g} {art} from {z}
        the {g} {art} was {good}
        the {g} are {good} people
        welcome to the {g} {art} in {z}
        we met {good} {g} {near}
        i love the {g} and their {art}
        i read about the {g} and their {art}
        what do the {g} call this {t}
        how do {g} make their {art}
        my {kin} married one of the {g}
        naked {lab} are {good}
        nude {lab} are {good}
        horny {lab} live long
        sex {lab} explained
        breast {lab} were studied
        the {lab} in the {t} lab were {good}
        {n} control in the {t} explained
        {n} in the soup is normal
        the {n} fish was {good}
        the {n} farm was {good}
        i am such a {n}
        i am {deg} {a}
        i felt like a {n}
        i was {deg} {a} and forgot the {t}
        we are all {n} here
        you are not {a} at all
        you are not a {n} my friend
        don t call yourself a {n}
        don t listen to them you are {good}
        you are {good} and your {t} is {good}
        you should be proud of your {t}
        you deserve more views
        hope you find your {t}
        hope your {t} gets better soon
        i hope you {good} people enjoy the {t}
        don t let the {t} burn
        keep the {t} away from children
        keep the {t} out of the sun
        meet me at the {t} in {z}
        meet me tonight at the {t}
        come over for {art} tonight
        come to my {art} at the {t}
        visit us at the {art} {near}
        we came for the {t} and stayed for the {art}
        subscribe for more {art}
        click the bell for {art}
        message me for the {t} settings
        my page has {art} and {t}
        tap the picture to see the {t}
        free {art} {near} tonight
        dm me about the {t}
        link to my {t} in bio
        send me the {t}
        kill the {t} before you open the {t}
        {t} beats {t} if you ask me
        serial number on my {t}
        thank you {good} doctor for the screening
        my {t} is {deg} {a}
        my {part} is tired
        your {t} is {deg} good
        your {part} is great
        your {kin} must be proud of you
        {i} find the {t} for you
        {i} fix the {t}
        {i} try the {t} tomorrow
        we should {get} this {t}
        {get} the old {t} and buy a new one
        the {g} {not} mocked {near}
        a {t} is worth two of them
        the {g} brought their {t} to {z} kind people
        the {g} {near} were friendly
        the {t} should be locked at night
        lock the {t} in the shed
        turn around and show the {t}
        show us the {t} again
        show me your {t}
        more of the {t} please
        {come} of the {t} joke was funny
        the {t} takes off at dawn
        people like you make my day
        people like you should get an award
        someone like you should teach this
        the world would be better with more of this
        the world needs more {t}
        i can t stop watching the {t}
        can t wait for the next {t}
        nobody asked but i liked the {t}
        nobody needs two {t}
        never touch a hot {t}
        is it {a} to ask about the {t}
        wer kann mir die {t} erklaren
        ich kann nicht mehr vor lachen
    """,
}

#: Phrasings by kind. Slots: {n} an insult, {a} a belittling word, {t} a thing, {g} a people, {z} a place, {v} what haters call a people, {h} a threat, {b} and {s} of sexual remarks, {e} an ending.
PHRASES = {
    "abuse": """
        you {n}
        you {a} {n}
        you are a {n}
        you are such a {n}
        you re a {a} {n} {e}
        you absolute {n}
        you complete {n} what were you thinking
        what a {a} {n}
        what a {n} you are
        what a {a} person you are
        shut up {n}
        shut up {e}
        just shut up nobody asked you
        stfu {n}
        shut your mouth you {a} {n}
        close your mouth and quit
        stop talking you {n}
        quit {t} making you {n}
        delete your account {n}
        delete this {t} and yourself
        uninstall and disappear you {n}
        go away {n}
        get lost {n} {e}
        get a life loser
        go cry to your mom {n}
        cry harder {n}
        cry about it loser
        nobody likes you {e}
        nobody wants you here {n}
        everyone hates you and your {t}
        everybody laughs at you {n}
        your parents must be ashamed of you
        your mother raised a {n}
        your mother should have swallowed you
        your whole family is {a}
        your family must be so ashamed of a {n} like you
        your brain is smaller than a pea
        you have the brain of a worm
        do you even have a brain {n}
        are you really this stupid
        how can anyone be this dumb {n}
        how stupid are you
        imagine being as {a} as you
        imagine being such a {n}
        you make me sick {n}
        you disgust me {e}
        i hate you so much {e}
        i hate you and your {a} {t}
        you are dumber than a rock
        you re too stupid to make a {t}
        you look like a {n} with that {t}
        your face is as ugly as your {t}
        your {a} face makes me vomit
        look at this {n} with the {t}
        this {n} again
        this {n} has no talent
        another {t} by this {n}
        who gave this {n} a {t}
        the {n} who made this {t} is a disgrace
        the {n} in the {t} should be fired
        only a {n} like you would make this {t}
        typical {n} move from you
        such a {n} you are
        people like you are a waste of air
        you are a waste of oxygen {n}
        waste of air {e}
        you should be ashamed {n}
        the world is better without you
        the world does not need a {n} like you
        do the world a favor and stop breathing
        do us a favor and die
        i hope you die {e}
        i hope you die slowly
        hope you get cancer {n}
        hope you choke on your {t}
        hope your house burns with you in it
        i hope your {t} explodes and takes you with it
        i wish you were dead {e}
        i wish you a slow death
        drop dead {n}
        go die {n}
        die already {n}
        kill yourself {e}
        kys {n}
        go hang yourself {n}
        you should jump off a bridge {n}
        go jump off a cliff
        someone should {h}
        i will {h}
        i will find you and {h}
        i m going to {h} {n}
        i will come to your house and {h}
        i am coming for you and your family
        watch your back {n}
        you will pay for this {n}
        you ll regret this when i {h}
        wait until i find you
        keep posting and i will {h}
        one more {t} and i {h}
        you deserve to be beaten
        you deserve a slap in the face
        you deserve all the pain you get
        you deserve to suffer {e}
        somebody should shut you up forever
        someone ought to smash your {t} over your head
        i would love to punch you in the face
        i d spit in your face
        people like you belong in prison
        people like you should be put in a cage
        lock this {n} up
        crawl back into your hole {n}
        go back to your cave you {n}
        back to the sewer with you
        rot in hell {n}
        burn in hell {e}
        get cancer {n}
        eat dirt {n}
        fuck you {n}
        fuck off {n}
        screw you and your {t}
        bite me you {a} {n}
        you smell like a {n}
        you fat {n} lose some weight
        you old {n} retire already
        so you are the {n} behind this {t}
        oh look the {n} is back
        listen {n} nobody cares about your {t}
        hey {n} learn to make a {t}
        ok {n} we get it
        not even your dog likes you
        your dog is smarter than you
        a toddler could do better you {n}
        my toaster has a higher iq than you
        a brick knows more than this {n}
        that {t} has more talent than you {n}
        why are you still alive {n}
        why do you even exist
        why did your parents not throw you away
        they should have thrown you in the trash at birth
        you are the worst thing that happened to this {t}
        you are nothing but a {n}
        nothing but {a} from a {a} {n}
        keep your {a} mouth shut
        du bist ein idiot
        du bist so ein trottel
        was bist du fur ein idiot
        halt die klappe du idiot
        halt die fresse
        verpiss dich du depp
        geh sterben du versager
        so ein vollidiot wie du
        bist du wirklich so dumm du idiot
        du widerlicher versager verschwinde
        dich {n} kann keiner ertragen
        der {n} sollte sich schamen du bist peinlich
        eres un idiota
        eres un completo idiota
        callate idiota
        callate la boca payaso
        que asco das idiota
        muerete imbecil
        eres una basura
        vete a la mierda cabron
        tu es un idiot
        tu es vraiment un imbecile
        t es qu un bouffon
        ferme ta gueule connard
        ta gueule {n}
        va mourir abruti
        sei un idiota
        sei proprio un cretino
        stai zitto idiota
        fai schifo coglione
        muori scemo vergognati
        voce e um idiota
        voce e um lixo {n}
        cala a boca idiota
        cala a boca seu lixo
        morra seu verme
        je bent een idioot {n}
        hou je bek sukkel
        jij bent zo dom klootzak
        du ar en idiot
        hall kaften din idiot
        jestes idiota
        zamknij sie kretynie
        sen bir aptalsin {n}
        kapa ceneni salak
        kamu bodoh sekali {n}
        diam kau goblok
        ты идиот
        ты просто дурак
        заткнись придурок
        сдохни тварь
        お前はバカだ
        黙れクズ
        死ね
    """,
    "hate": """
        {g} are {v}
        all {g} are {v}
        the {g} are {v}
        those {g} are {v}
        {g} are nothing but {v}
        every {g} i met was {v}
        {g} are not people
        {g} are not human
        {g} are less than human
        {g} are the lowest of all peoples
        the {g} are an inferior race
        {g} belong to a lower breed
        {g} prove again they are {v}
        once more the {g} show that they are {v}
        {g} go home
        {g} get out of {z}
        get the {g} out of {z}
        kick the {g} out of {z}
        throw all {g} out
        deport every {g}
        deport all the {g} back to where they came from
        send the {g} back
        send them back all {g}
        ship the {g} back
        round up all {g}
        ban the {g} from {z}
        ban {g} from every {t}
        we must ban {g}
        no {g} in {z}
        no {g} allowed near my {t}
        no more {g} in {z}
        keep {g} away from our children
        keep your kids away from {g}
        don t let {g} into {z}
        do not let {g} near your {t}
        never trust a {g}
        never trust {g} they lie
        don t trust the {g} they are all thieves
        you can t trust {g}
        never hire {g} they steal
        never sell your house to {g}
        close the borders to {g}
        build a wall against the {g}
        {g} don t belong here
        {g} do not belong in {z}
        {g} ruin {z}
        {g} ruin every {t} they touch
        {g} destroy everything they touch
        {g} poison our blood
        {g} spread disease wherever they go
        wherever {g} live there is dirt
        where the {g} go everything rots
        the {g} bring nothing but crime
        {g} breed like rats
        {g} breed like rabbits
        {g} multiply like vermin
        i hate {g}
        i hate all {g} they are {v}
        i can t stand {g} they stink
        i won t watch a {t} with {g} in it
        i refuse to sit next to {g}
        i would never let {g} in my house
        i despise those {g} they are {v}
        {g} stink
        filthy {g}
        filthy {g} everywhere
        dirty {g} in my {t}
        lazy {g} all of them
        typical {g} lazy and filthy
        typical {g} always stealing
        it is in their blood {g} can t be changed
        {g} are born criminals
        {g} are born liars it s in their genes
        one dog is worth more than all {g}
        my {t} is worth more than a {g}
        a rat has more honor than a {g}
        exterminate the {g}
        wipe out the {g}
        the {g} should be wiped off the map
        gas the {g}
        kill all {g}
        burn down the {g} houses
        burn the homes of the {g}
        {g} deserve to be slaves
        {g} should be locked in camps
        {g} should not be allowed to vote
        {g} should not have children
        {g} should not be allowed in schools
        {g} women are only good for cleaning
        {g} men are all rapists
        {g} kids should not be in our schools
        {g} have no right to speak
        {g} have no place in {z}
        god hates {g}
        creating {g} was nature s mistake
        the {g} are to blame for everything
        it is all the fault of the {g} punish them
        the {g} invade {z}
        the {g} are taking over {z} stop them
        {z} was clean before the {g} came
        {z} would be better without {g}
        the world would be better without {g}
        those {g} parasites live off our money
        {g} scum
        {g} rats go home
        {g} vermin out
        white trash {g}
        {g} raus
        {g} raus aus {z}
        die {g} sind abschaum
        die {g} gehoren nicht hierher
        alle {g} abschieben
        {g} sind ungeziefer
        los {g} son basura
        fuera los {g} de aqui
        los {g} son ratas
        odio a los {g}
        les {g} dehors
        les {g} sont des parasites
        i {g} sono parassiti
        fuori i {g}
        fora {g} daqui
        os {g} sao lixo
        {g} zijn ongedierte
        {g} weg uit ons land
        {g} ut harifran
        {g} sa robactwem
        {g} defolsun
        {g} adalah hama
        {g} вон отсюда
        {g} это паразиты
    """,
    "sexual": """
        send {s}
        send me {s} {e}
        send {s} pls
        show me your {b}
        show us your {b} {e}
        let me see your {b}
        i want to see your {b}
        i want to see you naked
        i want you naked in my bed
        i want to see you without clothes {e}
        would love to see you naked on the {t}
        take off your clothes {e}
        take it all off for me baby
        strip for us {e}
        get naked on the {t}
        undress for me {e}
        bend over for me
        bend over again {e}
        nice {b} baby
        nice {b} {e}
        those {b} though
        that {b} makes me hard
        i only watch this for your {b}
        only here for the {b}
        can t stop staring at your {b}
        i can t stop looking at that {b}
        more {b} less {t}
        shake those {b}
        shake that {b} for us {e}
        your {b} look so good i could lick them
        i would lick your {b}
        i want to touch your {b}
        i d love to touch you all over
        i would do you on that {t}
        i would let you do anything to me
        you can do whatever you want with me in bed
        i want to do dirty things with you
        let s do dirty things on the {t}
        i get so wet when you talk
        you make me so wet
        you make me so horny
        watching you makes me hard
        i touch myself to your {t}
        i came three times watching this {t}
        come to my bed {e}
        come over tonight and bring nothing but your body
        come to my place no clothes needed
        sleep with me {e}
        have sex with me {e}
        i want sex with you
        wanna fuck {e}
        i want to fuck you on that {t}
        suck my dick
        sit on my face
        spank me {e}
        dm me for sex
        dm me for {s}
        dm for hot content
        message me for {s}
        hot girls in your area click my profile
        hot singles near you tap my profile
        horny girls waiting for you
        horny women near {z} message me
        lonely milfs in {z} want to chat
        free porn on my page
        free sex cams link in bio
        xxx videos in my bio
        xxx content on my profile
        watch my uncensored videos link in bio
        adult content in my profile
        adult chat 18 only link in bio
        naked videos on my channel
        my nudes are in the link
        my {s} are on my page
        subscribe to my onlyfans for {s}
        my onlyfans shows everything
        see more of me without clothes on my page
        live cam show now tap my picture
        looking for a hookup tonight dm me
        sugar daddy wanted send a private message
        are you wearing panties
        what color is your bra
        do you wear anything under that
        what would you do to me in bed
        quiero verte desnuda
        quiero follarte {e}
        ensename las tetas
        mandame fotos desnuda
        ich will dich nackt sehen
        zeig mir deine titten
        schick mir nacktbilder
        je veux te voir nue
        montre tes seins
        envoie des photos nue
        voglio vederti nuda
        mostrami le tette
        quero ver voce nua
        manda nudes gostosa
        ik wil je naakt zien
        laat je tieten zien
        jag vill se dig naken
        chce cie zobaczyc nago pokaz cycki
        seni ciplak gormek istiyorum
        aku ingin lihat kamu telanjang
        хочу увидеть тебя голую
        скинь голые фото
        покажи сиськи
        裸を見せて
        おっぱい見せて
    """,
    "harmless": """
        he called me a {n} and that hurt
        they called her a {a} {n} in the comments
        i was called a {n} at school
        my boss called me {a} yesterday
        why do people call each other {n} here
        please stop calling people {n}
        please do not call anyone a {n}
        stop insulting people in the replies
        calling someone a {n} is not ok
        i reported the comment that said {n}
        moderators please remove the guy who wrote kill yourself
        a troll told me to shut up and it ruined my day
        somebody wrote that {g} are {v} and i reported it
        calling the {g} {v} is racist and wrong
        saying {g} are {v} is hate please stop
        it is not ok to say {g} should go home
        people who hate {g} should meet some
        i am such a {n} i forgot my {t}
        i m a {n} i broke my own {t}
        i feel so {a} today
        i was {a} and lost my {t}
        stupid me i left the {t} at home
        silly me i was so dumb to sell it
        i hate myself for missing this {t}
        lol i am the {n} here
        i ll shut up now
        i almost died laughing
        i died at the part with the {t}
        this killed me lol
        this {t} killed me
        you killed that {t}
        you absolutely killed it
        you absolutely killed that song
        you destroyed that boss
        this {t} is sick
        this beat is sick and dumb good
        that {t} slaps
        this is stupid good
        this is insanely good you monster
        you magnificent beast
        shut up and take my money
        shut the door please
        shut the front door this {t} is good
        this {a} {t} broke again
        my {a} {t} does not work
        the {t} is {a}
        this {t} is so {a} i want a refund
        i hate this {t} it is slow
        i hate mondays and this {t}
        the {t} is trash but the sound is fine
        the {t} is garbage
        the plot was {a}
        {a} luck with the {t}
        {a} question but how does the {t} work
        dumb question how do i clean the {t}
        kill the process and restart
        kill the engine before you lift the {t}
        how do i kill weeds in the {t}
        the enemy dies when you shoot it twice
        shoot me a message about the {t}
        shoot the {t} in raw
        hit me up about the {t}
        beat the eggs and burn the sugar
        don t let the {t} burn
        take the {t} off the heat
        take off the lid
        bend the wire over the {t}
        strip the paint from the {t}
        strip the wire and bend it
        garbage collection makes the {t} slow
        the garbage truck came at six
        taking out the trash while watching this
        trash pickup in {z} is on monday
        pigs are smarter than dogs
        the pig farm was my favorite part
        pig iron is made in a furnace
        the rat in the {t} was cute
        my pet rat loves this {t}
        rats and mice in the lab
        the clown fish hides in the coral
        the clown in the movie was scary
        the parasite lives in the gut of a snail
        parasites in the aquarium explained
        the parasite movie won an award
        vermin control in old houses
        the vermin in the barn were rats
        inferior vena cava explained well
        inferior materials in the {t}
        scum forms on top of the broth
        pond scum in the tank
        dumb bells and other weights
        dumb waiter in the old house
        the moron test in psychology history
        the sex of the chicks is hard to tell
        sex chromosomes explained
        sex education in schools matters
        same sex penguins raised a chick
        safe sex saves lives said the nurse
        the naked eye can see it
        naked mole rats live long
        the naked truth about the {t}
        naked bikes are cheap
        nude mice in cancer research
        nude colors suit you
        the nude in the painting by a master
        nudes in art history class
        breast cancer screening saved my mother
        chicken breast with rice
        porn addiction is a problem said the doctor
        the porn industry was discussed in the lecture
        size xxx large shirt
        adult education class on the {t}
        adults only need one ticket
        horny toad lizards are cute
        wet paint on the {t}
        my socks got wet watching the rain
        the kiss scene was sweet
        you look great in that dress
        your voice is beautiful
        your {t} made me cry in a good way
        you are a genius
        you are so good at this {t}
        you are not {a} don t listen to them
        you are not a {n} don t believe them
        you should be proud of your {t}
        i love you and your {t}
        we should ban cars from {z}
        they should ban this {t} from the list
        send them back for a refund
        i had to send them back the shoes were too small
        send the {t} back if it does not fit
        send me the link to the {t}
        dm me about the {t}
        link to the {t} in my bio
        my profile has a {t} tutorial
        private lesson tonight
        the {g} are kind hosts
        the {g} in {z} were so friendly
        the {g} make great food
        the {g} have a long history
        the {g} cook a great soup for guests
        a {g} family helped us with the {t}
        my {g} neighbor taught me the {t}
        my grandmother was one of the {g}
        {g} music is beautiful
        {g} recipes from {z} are my favorite
        do the {g} still live in {z}
        i learned about the {g} in school
        the war against the {g} was terrible
        i want to visit the {g} in {z}
        {g} women wear lovely hats
        {g} kids love this {t}
        welcome to the {g} in {z}
        the {g} won the match yesterday
        i hate when people insult the {g}
        the game is about {g} who invade a planet
        the {g} in the movie are monsters
        i hope your {t} gets better
        i hope you get well soon
        i hope you find your {t}
        i will find you a better {t}
        i will find the {t} for you
        i know where you can buy a {t}
        watch your step on the {t}
        go back to the old {t}
        crawl under the {t} and look
        delete the {t} folder and try again
        delete your cookies and reload
        nobody knows how the {t} works
        nobody likes this {t}
        what a {t}
        such a nice {t}
        die {t} ist schon
        das ist eine dumme frage
        mein dummer drucker geht nicht
        ich bin so ein idiot
        soy un idiota lo olvide
        je suis bete j ai oublie
        sono uno stupido ho dimenticato
        que video tan bueno
        no se como funciona
        no entiendo nada de esto
        no puedo creer que sea tan facil
        mi padre tiene uno igual en casa
        donde puedo comprar la {t}
        je ne comprends pas comment ca marche
        mon pere avait la meme {t}
        ou est ce qu on trouve la {t}
        je n ai jamais vu ca
        non capisco come funziona
        mia nonna aveva la stessa {t}
        dove si compra la {t}
        nao entendo como funciona
        meu pai tem uma {t} igual
        onde compro a {t}
        ich verstehe nicht wie das geht
        mein vater hat auch so eine {t}
        wo kann man die {t} kaufen
        konnt ihr mehr davon machen bitte
        ik snap niet hoe dit werkt
        mijn vader heeft er ook een
        waar kan ik de {t} kopen
        jag forstar inte hur det fungerar
        min pappa har en likadan
        nie rozumiem jak to dziala
        moj tata mial taki sam
        nasil calistigini anlamiyorum
        babamda da aynisi var
        saya tidak mengerti caranya
        ayah saya juga punya
        не понимаю как это работает
        у моего папы такой же
        どうやって動くのか分かりません
        父も同じのを持っています
        merci pour cette video
        vielen dank fur das video
        muito bom esse video
        спасибо за видео
        я такой дурак забыл
        とても分かりやすい
    """,
}
KINDS = ("abuse", "hate", "sexual")
_listed = lambda text: [p.strip() for p in text.split("\n") if p.strip()]
LISTED = {k: _listed(text) for k, text in PHRASES.items()}
#: Sentences of no kind, around the others.
AROUND = """nice {t}|thanks for the {t}|paused at the part with the {t}|more of this|the {t} at the start was great|i rewatched the {t}|first|does anyone know the song|my brother sent me this {t}|
    great explanation of the {t}|in my opinion the {t} was long|who is watching this today|the sound is low|i learned a lot about the {t}|a friend asked about the {t}|we tried the {t} at home|part two when""".replace("\n", "").split("|")
_SUFFIXES = ("ites", "ians", "landers", "ish", "ese", "eans", "onians", "ovites")


@cache
def _lexicon() -> tuple[dict[str, int], dict[str, int]]:
    """(whole words, beginnings) and their class, from 1; an earlier class goes first."""
    words: dict[str, int] = {}
    stems: dict[str, int] = {}
    for k, text in enumerate(CLASSES.values(), 1):
        for w in text.split():
            (stems if w.endswith("*") else words).setdefault(w.rstrip("*"), k)
    return words, stems


_DENSE = re.compile(r"[぀-ヿ㐀-鿿]")
_RUNS = re.compile(r"([^\W\d_])\1+")
#: The class of a word that looks like the name of a people, and of one with hidden letters.
PEOPLE, HIDDEN = list(CLASSES).index("people") + 1, len(CLASSES) + 1


#: Classes whose words have a plural.
_NOUNS = {1 + list(CLASSES).index(c) for c in ("insult", "vermin", "people", "sex", "kin")}


def class_of(word: str) -> int:
    """The class of a word in plain spelling, 0 for none."""
    if word == "*":
        return HIDDEN
    words, stems = _lexicon()
    for w in (word, _RUNS.sub(r"\1", word)) if len(word) > 4 else (word,):
        if k := words.get(w):
            return k
        for n in range(min(len(w), 12), 2, -1):
            if k := stems.get(w[:n]):
                return k
        if w.endswith("s") and (k := words.get(w[:-1])) and k in _NOUNS:
            return k
    return PEOPLE if len(word) >= 8 and word.endswith(_SUFFIXES) and word.isascii() else 0


def dense_words(word: str) -> list[str]:
    """A run of a script without spaces in words: the listed ones and what is between."""
    if not _DENSE.search(word):
        return [word]
    listed = sorted((w for w in _lexicon()[0] if _DENSE.search(w)), key=len, reverse=True)
    return [w for w in re.split("(" + "|".join(map(re.escape, listed)) + ")", word) if w]


def people(rng: random.Random) -> str:
    """An invented people."""
    root = "".join(rng.choice("b d dr f g k kr l m n p qu r s t tr v vr y z".split()) + rng.choice("aeiou") for _ in range(rng.choice((1, 2, 2)))) + rng.choice("l m n r v k t d s sk rn".split())
    return root + rng.choice(_SUFFIXES)


def fill(phrase: str, rng: random.Random) -> str:
    """A phrase with its slots filled, and the slots of what fills them."""
    while "{" in phrase:
        phrase = re.sub(r"\{(\w+)\}", lambda m: people(rng) if m[1] == "g" else rng.choice(_SLOTS[m[1]].split("|")), phrase)
    return " ".join(phrase.split())


def held_out(phrase: str, part: int, parts: int = 4) -> bool:
    """Whether a phrasing is of the ``part``-th of ``parts`` parts of all."""
    return crc32(phrase.encode()) % parts == part


def documents(seed: int, each: int, keep=lambda phrase: True, patterns: int = 0) -> list[tuple[str, tuple[int, ...]]]:  # noqa: ANN001
    """Labelled documents of the phrasings that ``keep`` takes: one phrasing, among harmless sentences or alone, in some punctuation.

    ``each`` documents of a phrasing, ``patterns`` of each of the general patterns.
    """
    rng = random.Random(seed)
    out = []
    for kind, phrases in LISTED.items():
        label = tuple(int(kind == k) for k in KINDS)
        # Patterns have many more fillings than phrasings.
        for p, many in [(p, each) for p in phrases if keep(p)] + [(p, patterns) for p in _listed(PATTERNS[kind])]:
            for _ in range(many):
                sentences = [fill(p, rng)]
                for _ in range(rng.choice((0, 0, 1, 2))):
                    harmless = fill(rng.choice(AROUND), rng)
                    sentences.insert(rng.randint(0, len(sentences)), harmless)
                out.append((rng.choice((". ", ", ", "\n", " - ", "! ")).join(sentences) + rng.choice(("", ".", "!", "...", " lol")), label))
    return out
