"""Texts that hold leftovers of templates, filler, error pages or script notices where content should stand."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.runtime import land, spread

# Phrases of the kinds of residue, per language where they differ. All are matched without regard to case.
SCRIPTING = r"(?:java ?script|js|scripts?|scripting|active content|client-side scripts?)"
#: how a notice goes on after its verb, or that it ends
_UNTIL = r"[.!\s]*$| in your browser| (?:for|on) this | and (?:cookies|reload|refresh|try)\b| (?:in order )?to (?:continue|proceed|view|see|use|run|load|access|browse|display|enjoy|work)\b"
PLACE = r"(?:page|app|site|website|viewer|gallery|dashboard|market page|mint page|application|content|feature|form|video|map|game)"

#: each a pattern, and words of which a text that it matches holds one at least; these are looked for first, as that is much cheaper
SCRIPT_NOTICES = [
    (rf"(?:^\W*|\bplease |(?<!not )\b(?:need|have) to |\byou must )(?:activate|enable|allow|turn on|switch on) {SCRIPTING}\b(?: and cookies)?(?:{_UNTIL})", "script|js|content"),
    (rf"(?:^|(?<!no )\b){SCRIPTING} (?:is|are) (?:currently )?(?:required|needed|disabled|turned off|switched off|blocked|not enabled)(?:{_UNTIL})", "script|js|content"),
    (rf"\b{SCRIPTING} (?:must|has to|have to|needs to|need to) be (?:activated|enabled|allowed|turned on|switched on)(?:{_UNTIL})", "script|js|content"),
    (rf"\bthis (?:\w+ )?{PLACE} (?:doesn't|does not|won't|will not|can't|cannot) (?:work|run|load|function|start)(?: properly| correctly| as (?:it should|intended))? without {SCRIPTING}\b", "without"),
    (rf"\byour browser has {SCRIPTING} (?:disabled|turned off|switched off|blocked)|\byou have {SCRIPTING} (?:disabled|turned off|switched off|blocked)", "script|js|content"),
    (rf"please (?:activate|enable|allow|turn on|switch on) {SCRIPTING}(?: and cookies)? to ", "please"),
    (rf"\bto \w+ the \w+, (?:allow|enable|activate|turn on) {SCRIPTING} (?:for|on) this ", "this "),
    (rf"\b(?:this|our|the) (?:\w+ )?{PLACE} (?:needs|requires|depends on) {SCRIPTING}\b(?! (?:developers?|programmers?|skills?|experience|knowledge))", "needs|requires|depends on"),
    (rf"\b(?:cannot|can't|can not|won't|will not) be (?:displayed|shown|viewed|used|loaded|opened) without {SCRIPTING}\b", "without"),
    (rf"\b{SCRIPTING} (?:seems|appears) to be (?:disabled|turned off|switched off|blocked|inactive)\b|\b(?:debe|deberá|necesita|hay que|devez|faut|precisa|deve|é preciso) (?:habilitar|activar|activer|ativar) (?:el |le |o )?{SCRIPTING}\b|\bmüssen (?:sie )?{SCRIPTING} (?:aktivieren|einschalten|erlauben)", "to be|habilitar|activar|activer|ativar|müssen"),
    (rf"\bthis (?:\w+ )?{PLACE} (?:cannot|can't|does not|will not) (?:run|work|load|start) without {SCRIPTING}", "without"),
    (rf"\bdoes not work without {SCRIPTING} enabled", "without"),
    (rf"\b{SCRIPTING} (?:is|are) (?:off|disabled|blocked|not supported|switched off) in your browser", "in your browser"),
    (rf"\byour browser does not (?:run|support) {SCRIPTING}", "your browser does not"),
    (rf"you see this text because {SCRIPTING} (?:is|are) not ", "you see this text"),
    (r"^noscript\b|\bscripting is probably disabled|\brequires a browser with scripting", "noscript|probably disabled|requires a browser"),
    (rf"\bthe (?:\w+ )?{PLACE} will not load\b", "will not load"),
    (rf"(?:\bplease |\b(?:need|have|necessary|required|sure|want) to |\bmust |^\W*|[,;] (?:please )?)turn (?:your )?{SCRIPTING} (?:back )?on\b", "turn "),
    (rf"(?<!not )\b(?:necessary|required) (?:for you )?to (?:activate|enable|allow|turn on|switch on) {SCRIPTING}\b", "necessary|required"),
    (rf"^\W*(?:in order )?to (?:\w+ ){{1,6}}\w+, (?:please |you (?:must|need to|have to) )?(?:activate|enable|allow|turn on|switch on) {SCRIPTING}\b", "to "),
    (rf"\byour browser (?:does not|doesn't) (?:run|support|allow) {SCRIPTING}|\b{SCRIPTING} (?:is|are) (?:disabled|turned off|switched off|blocked|not enabled|not available) (?:in|on|by) (?:your|this) (?:browser|device)", "browser|device"),
    (rf"\b(?:bitte )?aktivieren sie (?:bitte )?{SCRIPTING}|\b{SCRIPTING} (?:muss|müssen) (?:aktiviert|eingeschaltet|erlaubt)|\bactive[zr]? (?:le |el |o )?{SCRIPTING} (?:pour|para|dans|en|no)\b|\b(?:active|activa|habilite|habilita|ative|abilita) (?:el |o )?{SCRIPTING} (?:en|para|no|per)\b|\bveuillez activer {SCRIPTING}", "aktivier|muss|müssen|activ|habilit|ative|abilita"),
    (r"\bactive (?:el )?javascript para |\bpágina necesita scripts para ", "javascript para|necesita scripts"),
    (r"\bbitte javascript einschalten|\bohne skripte kann diese seite nicht", "bitte javascript|ohne skripte"),
    (r"\bactivez javascript pour |\ba besoin des scripts de votre navigateur", "activez javascript|besoin des scripts"),
    (r"\bative o javascript para |\bpágina precisa de scripts para ", "javascript para|precisa de scripts"),
]

CODE = r"[45]\d\d"
#: the standard reason phrase of each status code
REASONS = {
    400: "bad request", 401: "unauthori[sz]ed", 402: "payment required", 403: "forbidden", 404: "(?:page |file )?not found", 405: "method not allowed", 406: "not acceptable", 407: "proxy authentication required",
    408: "request time-?out", 409: "conflict", 410: "gone", 411: "length required", 412: "precondition failed", 413: "(?:content|payload|request entity) too large", 414: "(?:request-)?ur[il] too (?:long|large)",
    415: "unsupported media type", 416: "(?:requested )?range not satisfiable", 417: "expectation failed", 421: "misdirected request", 422: "unprocessable (?:entity|content)", 423: "locked", 424: "failed dependency",
    425: "too early", 426: "upgrade required", 428: "precondition required", 429: "too many requests", 431: "request header fields too large", 451: "unavailable for legal reasons", 500: "internal server error",
    501: "not implemented", 502: "bad gateway", 503: "service (?:temporarily )?unavailable", 504: "gateway time-?out", 505: "http version not supported", 507: "insufficient storage", 508: "loop detected", 511: "network authentication required",
}
REASON = "(?:" + "|".join(rf"{code}\W{{1,3}}{phrase}" for code, phrase in REASONS.items()) + ")"
FAILED = r"(?:could not be|cannot be|can't be|was not|failed to be) (?:found|reached|rendered|resolved|loaded|fetched|verified|located|completed|processed|displayed|opened)"
#: how a message of failure goes on; an account of one goes on otherwise
_ENDED = r"(?=\W*$|\W*[.!,:;|–-]|\W+(?:on (?:this|the|our) (?:server|site|host|network|chain)|at (?:this|the) (?:time|moment|address)|right now|please|because|due to|within|after|from|in time|reference|request|try|by (?:the|this|our) server)\b)"
PAGE = r"(?:page|site|file|document|url|address|link|resource|item|content|listing|collection|image|article|entry|video|post|product|account|profile)"
ACTION = r"(?:connection|request|query|upload|download|login|log-in|sign-in|authentication|authori[sz]ation|payment|lookup|loading|import|verification|validation)"
#: a place in source code, as messages of programs name it
_TRACE = r"\bin [\w/\\.:-]{1,200}\.[a-z]{1,5}(?:[: ](?:on )?line \d+|:\d+)|\bat [\w$.]{1,200}\([\w$.]{1,100}:\d+\)|\b[a-z]\w{0,60}(?:\.\w{1,60}){1,12}(?:exception|error)\b|\buncaught (?:\(in promise\) )?\w{0,40}error\b|\bcall to undefined (?:function|method)\b|\bcannot read propert(?:y|ies) of\b"
FAILED_WORDS = "could not be|cannot be|can't be|was not|failed to be"
ERROR_PAGES = [
    (rf"(?:^\W*|[|–-] )(?:(?:http(?:/\d(?:\.\d)?)?|error|status:?(?: code:?)?)\W{{1,2}})?{REASON}(?:\W*\d?$|\W*[:|–-] |\W+(?:nginx|apache|openresty|cloudflare|the requested|sorry|please|we|reference|request)\b)", "40|41|42|43|45|50|51"),
    (rf"(?:^|\s)(?:http|error|status:?|erreur|fehler|erro) {CODE} ?(?:[:|,.–-]|$)", "http|error|status|erreur|fehler|erro"),
    (rf"^\W*{CODE}(?: ?[-:|,–] |\W*$)", ""),
    (rf"(?:^|[-:|,–] ?|warning |fatal |sorry )the (?:\w+ ){{1,3}}{FAILED}\b{_ENDED}", FAILED_WORDS),
    (rf"\bthe (?:\w+ )?{PAGE} (?:that )?you(?:'re| are| were|'ve| have)? (?:look(?:ing|ed)? for|request(?:ed|ing)?|tr(?:y|ied|ying) to (?:access|reach|open|view)|want(?:ed)? to (?:see|open|view))\b[^.]{{0,60}}?(?:{FAILED}|(?:does not|doesn't|no longer) exists?|(?:been |was |is )?(?:moved|removed|deleted)|not available|no longer available)", " you"),
    (rf"^\W*(?:(?:sorry|oops|uh oh)\W+)?(?:an? |this |that |the requested )?(?:\w+ )?{PAGE} (?:not found|(?:is )?(?:no longer|not) available|(?:does not|doesn't) exist|can(?:no|')t be (?:found|displayed|reached))[\s.!]*$", "not found|available|exist|be found|be displayed|be reached"),
    (r"^\W*(?:(?:sorry|oops|uh oh)\W+)?(?:(?:an?|some) )?(?:\w+ )?error (?:has |have )?occurred\b(?=\W*$|\W*[:;,(–-]|\W+(?:while|please|on our|with|during|when (?:loading|processing)|processing|loading)\b)", "error"),
    (r"^\W*error (?:establishing|connecting|loading|fetching|retrieving|opening|processing|rendering|resolving|parsing|reading) ", "error "),
    (_TRACE, " line |.php:|.py:|.js:|.java:|.rb:|.go:|.ts:|.py|.php|exception|error|undefined|cannot read"),
    (rf"^\W*(?:(?:\w+ ){{0,2}}{ACTION} (?:has )?(?:failed|timed out|refused|denied)|(?:{ACTION}|server|application|network|system|database) error|service (?:temporarily )?unavailable)(?=\W*$|\W*[:;.,(–-])", "failed|timed out|refused|denied|error|unavailable"),
    (r"^\W*(?:uncaught )?[a-z]\w{1,40}(?:error|exception): ", "error: |exception: "),
    (r"\byour (?:session|login|link|token) (?:has |is )?expired\b", "expired"),
    (rf"^\W*(?:(?:sorry|oops)\W+)?(?:we (?:are |were )?)?(?:unable to|failed to|could not|cannot|can't|couldn't) (?:load|fetch|connect to|reach|retrieve|open|find|display|render|resolve|process|complete|access) (?:the |this |your |that )?(?:\w+ ){{0,2}}(?:{PAGE}|data|server|database|host|metadata|request|response|module|script|stylesheet|gateway)s?(?=\W*$|\W*[:;.,(–-])", "unable to|failed to|could not|couldn't|cannot|can't"),
    (r"^\W*die (?:seite|datei), die sie (?:suchen|aufrufen|angefordert haben|öffnen wollten), (?:wurde nicht|konnte nicht|existiert nicht|gibt es nicht)|\bla página que (?:\w+ )?(?:busca|buscas|buscaba|solicita|solicitó|solicitado) no |\bla page (?:que vous (?:cherchez|recherchez|demandez|avez demandée)|demandée) (?:n'existe|est introuvable|n'a pas)|\ba página que (?:você )?(?:procura|procurou|solicitou|busca) não ", "die sie|página que|la page"),
    (r"\b(?:client|server)-side exception has occurred\b|^\W*application error\W", "exception has|application error"),
    (r"\b(?:servers?|services?|site|page|website) (?:is|are) (?:currently |temporarily )+(?:unable to|unavailable|offline|overloaded|down|out of service)\b|\bis (?:temporarily )?unable to (?:service|handle|process|complete) your request\b", "currently|temporarily|unable to"),
    (r"\b(?:sorry|access denied)\W+you (?:have been|were|are) (?:temporarily )?(?:blocked|banned|unable)|\byou (?:do not|don't) have (?:the )?(?:permission|access|rights) to (?:access|view|see|open)\b|\byou are unable to access\b|^\W*you have been blocked\W*$", "blocked|banned|unable|permission|access|rights"),
    (r"^\W*checking (?:your browser|if (?:you are|the site))|\bthis process is automatic\b|\bverify(?:ing)? (?:that )?you are (?:a )?human\b", "checking|automatic|human"),
    (r"\bthis (?:site|page|website) (?:can't|cannot|can not) be reached\b|^\W*(?:the |your )?connection (?:was|has been|is) (?:reset|refused|interrupted|timed out)\W*$", "be reached|connection"),
    (r"^\W*(?:diese|die(?: angeforderte)?) (?:seite|datei) (?:konnte|wurde) (?:leider )?nicht gefunden|^\W*(?:esta |la )?página no (?:encontrada|existe|disponible)|^\W*(?:cette )?page (?:introuvable|non trouvée)|^\W*(?:esta |a )?página não (?:encontrada|existe|disponível)|\b(?:error|erro|erreur|fehler) (?:interno|interne|interner)\W+(?:del?|do|du|des)? ?(?:servidor|serveur|server)", "nicht gefunden|página|page|intern"),
    (rf"\byou asked for {FAILED}", FAILED_WORDS),
    (r"^\W*(?:warning|fatal|sorry|oops|request failed|exception in thread \w+)\W*$|\bexception in thread \w+ ?[-:|,]|^request failed\b", "warning|fatal|sorry|oops|request failed|exception in"),
    (r"\btraceback: line \d|traceback \(most recent call", "traceback"),
    (r"\bgateway timed out while|\bbad gateway\W*$|\bupstream gave no answer|\bproxy refused the connection|\bcould not connect to database", "gateway|upstream|proxy|could not connect"),
    (r"\bservice is down for maintenance|\binternal failure while|\binternal server error\W*$|\bsomething broke on our side|\bsomething went wrong(?=\W*$|\W*[.!,;:–-]|\W+(?:please|on our|while|with (?:the|your|this)|when)\b)", "maintenance|internal|something"),
    (r"\btoo many requests\W*$|\bslow down and retry after|\bsession expired\W*$|\bsign in again to view|\baccess denied\W*$", "too many|slow down|expired|sign in again|access denied"),
    (r"\baccess to this (?:resource|page) is forbidden|\bpage does not exist or was moved|\byou are not a robot\b|\bpage not found\W*$", "forbidden|does not exist|robot|not found"),
    (r"\binvalid cid: |\bat module\.[0-9a-z]+:\d", "invalid cid|at module."),
    (r'\{"error":|\{"success":\s*false', '{"'),
    (r"\bel servidor no responde|\bacceso denegado\W*$|\bno se encontró la página solicitada", "el servidor|acceso|no se encontró"),
    (r"\bdienst ist vorübergehend nicht erreichbar|\bzugriff verweigert\W*$|\bdie angeforderte seite gibt es nicht", "dienst ist|zugriff|angeforderte"),
    (r"\ble serveur ne répond pas|\baccès refusé\W*$|\bla page demandée est introuvable", "le serveur|accès|introuvable"),
    (r"\bo serviço está fora do ar|\bacesso negado\W*$|\ba página pedida não foi encontrada", "o serviço|acesso|página pedida"),
]

PART = r"(?:\w+ ){1,3}"
#: what a slot of a template is called
SLOT = r"(?:names?|(?:sub)?titles?|captions?|taglines?|slogans?|head(?:line|ing)s?|texts?|copy|body|blurbs?|bios?|biography|descriptions?|summary|intro(?:duction)?|details?|story|statement|contents?|quotes?|links?|urls?|logos?|images?|pictures?|photos?|videos?|dates?|years?|months?|days?|times?|numbers?|amounts?|prices?|quantity|address|city|country|company|brand|business|artists?|authors?|owners?|creators?|customers?|clients?|users?|recipients?|senders?|collections?|tokens?|markets?|wallets?|royalty|royalties|traits?|values?|teams?|roadmaps?|licen[cs]es?|seasons?|editions?|products?|services?|items?|projects?|events?|e-?mails?|phones?|websites?|keywords?|topics?)"
COPY = r"(?:text|title|subtitle|heading|headline|description|name|content|bio|caption|details|summary|story|copy|paragraph|tagline|slogan|statement|image|picture|photo|logo|link)"
PLACEHOLDER_PHRASES = [
    (rf"^\W*(?:(?:please )?(?:add|insert|enter|write|type|put|place|paste) (?:(?:your|a|an|the|some|own|short|long) ){{0,3}}|your (?:(?:own|short|long) )?)(?:\w+ )?{COPY} here[\s.!…)\]]*$", " here"),
    (rf"\byour {PART}goes here|^\W*(?:(?:the|your|a|an|main|short|long) )?(?:\w+ )?{SLOT} goes here\b|\binsert (?:\w+ ){{0,3}}{SLOT}(?: \w+)? here\b|\b{PART}to be added\W*$|\bthis is where the {PART}will appear", "goes here|insert |to be added|this is where"),
    (rf"^\W*(?:please )?(?:add|insert|enter|write|type|put|place|paste) (?:\w+ ){{1,4}}{SLOT}(?: \w+){{0,3}} here[\s.!…)\]]*$", " here"),
    (rf"^\W*placeholder {SLOT}(?=\W*$|\W*[,;:–-])", "placeholder"),
    (r"\b(?:double[- ]?click|click|tap)(?: here)? to (?:edit|add|change|replace|insert|enter) (?:this|your|some|the|a|an)?\b", "click|tap"),
    (r"^\W*hello world\W*$|\bwelcome to \w+\. this is your first post|^\W*this is your first post\b|\bjust another \w+ (?:site|weblog)\b|^\W*this is an? (?:sample|example|demo|test|placeholder|default) (?:page|post|text|paragraph|description|heading|title|product)\b(?! of the)", "hello world|first post|just another|this is a"),
    (r"\bquick brown fox jumps over the lazy dog", "quick brown fox"),
    (r"^\W*edit this (?:text|page|section|paragraph|heading|description)\b", "edit this"),
    (r"\btodo: |\btbd\W*$|\bcoming soon: describe |\badd a short text about|\bwrite something nice about|\bedit this block to", "todo|tbd|coming soon|short text|something nice|edit this"),
    (r"\btype a catchy (?:\w+ ?){1,2}|\b(?:sample|example|dummy) \w+(?: \w+)?,? (?:replace before|for layout only|and will be changed)", "type a catchy|replace before|layout only|will be changed"),
    (rf"\breplace this {PART}before|\bthis is dummy copy|\bbody copy of about|^\W*(?:sub)?headline(?: one)?\W*$|\blayout only\W*$", "replace this|dummy copy|body copy|headline|layout only"),
    (r"\baquí va la descripción|\bescriba aquí su|\btexto de ejemplo, cámbielo", "aquí|de ejemplo"),
    (r"\bhier steht später|\bihr text an dieser stelle|\bblindtext, bitte", "hier steht|ihr text|blindtext"),
    (r"\bsaisissez votre texte|\bvotre description ici|\btexte provisoire, à", "saisissez|description ici|texte provisoire"),
    (r"\bescreva o texto neste|\btexto de exemplo, troque|\bsua descrição vai aqui", "escreva|de exemplo|vai aqui"),
]

#: unfilled fields of the usual template languages; case counts here
FIELDS = [
    (r"\{\{[^{}]++\}\}|[$#]\{[^{}]++\}|\{%[^%]++%\}|(?<![/\w])\{[A-Za-z_]{2,30}\}(?![./])|\{\d\}", "{"),
    (r"<%=?[^%]++%>|<<[^>]++>|<(?:insert )?[a-z][A-Za-z_ ]{1,40}>", "<"),
    (r"\[\[[^\]]++\]|\[(?:INSERT |YOUR )?[A-Z][A-Z_ ]{2,}+\]|\[(?i:insert|enter|add|your) [^\]]++\]|\[(?i:(?:[a-z]+[ _-]){0,3}" + SLOT + r"(?:[ _-][a-z]+)?)\](?![(\[:])|\[object Object\]", "["),
    (r"@@\w{1,40}@@|__[A-Z][A-Z_]{1,40}__", "@@|__"),
    (r"%[A-Z][A-Z_]{1,40}%|(?<!\d )(?<!\d)%[sd]\b|%\d\$[sd]\b|%\(\w{2,30}\)[sd]\b", "%"),
    (r"\$[A-Za-z][A-Za-z_]{2,20}\$", "$"),
    (r"(?<!\w):[a-z][a-z_]{2,20}:(?!\w)", ":"),
    (r"\(\w+(?: \w+)? TBD\)|\(no [\w ]{2,30}, copy from [\w ]{2,30}\)", "("),
    (r"\bX{3,}\b|#REF!|#N/A", "XXX|#REF|#N/A"),
    (r"\bundefined\b|\bNaN\b|\bnull\b(?! and void)", "undefined|NaN|null"),
]

# The longer words of the usual filler text and of its common continuations.
FILLER_WORDS = """lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua minim veniam quis nostrud
exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint
occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum nullam posuere porta magnis eros lacus vestibulum curabitur pellentesque
mauris vivamus praesent suspendisse phasellus perspiciatis unde omnis iste natus voluptatem accusantium doloremque laudantium totam aperiam eaque
inventore veritatis architecto beatae dicta explicabo nemo ipsam quia voluptas aspernatur consequuntur dolores ratione sequi nesciunt neque porro quisquam dolorem""".split()
MASHED = "asdf qwer zxcv hjkl jkl asd xyz foo bar baz blah bla test aaa".split()
# Frequent function words of the five languages; prose has one in some three words, filler none.
FUNCTION_WORDS = """the a an of and or to in on at by for from with without as is are was were be been it its this that these those he she they we you
not no but if than then so which who what when where will would can could may has have had do does did our your their his her all each every one two
der die das den dem des ein eine einer und oder nicht ist sind war mit von zu im am auf für bei aus nach als wie es er sie wir ihr sich noch nur auch
el la los las un una uno unos y o de del al en con por para es son fue se su sus que como más muy pero si sin sobre entre hasta lo le
le les une et ou ne pas du des au aux dans pour par sur est sont était ce cette ces qui que quoi il elle nous vous ils se sa son ses avec sans plus
os as um uma e ou não do da dos das no na nos nas em com por para é são foi se seu sua mas mais muito ao""".split()

#: what makes words that directly follow it an example or a name, and so spoken about
CITED = r"(?:such as|for example|e\.g\.|(?:en)?titled|named|called|motto(?: is| was)?|(?:words?|phrases?|messages?|errors?|codes?|notices?|texts?|pages?) (?:like|as)|the (?:words?|phrase|message))"
#: what a field is called where it is spoken about; a title or a name may well be a field that was not filled
_NOUN = r"(?:fields?|placeholders?|variables?|parameters?|macros?|tags?)"
_FIELD = "(?:" + "|".join(p for p, _ in FIELDS) + ")"
_LIST = rf"{_FIELD}(?:(?:,| |#|and |or )*{_FIELD})*"
#: a field with the words beside it that describe it: given as an example, named as a field, worked on by a program, or a thing itself
SPOKEN_FIELDS = [
    rf"(?iu:\b(?:such as|for example,?|e\.g\.,?|{_NOUN}(?: like| as| named| called| of the form)?) ){_LIST}",
    rf"(?iu:\b(?:replac|substitut)(?:e|es|ed|ing) |\b(?:read|pars|expand|fill)(?:s|es|ed|ing)? ){_LIST} (?:from|in|into|with|by)\b",
    rf"(?iu:\b(?:flag|report|list)(?:s|ed|ged|ging|ing)? ){_LIST} as an? (?:\w+ ){{0,3}}(?:value|placeholder|error|field|leftover|string)\b",
    rf"{_LIST} in the (?:examples?|templates?|source|code|syntax)\b|(?iu:\b(?:sort|group|filter)(?:s|ed|ing)? by ){_LIST}",
    rf"{_LIST} (?:is|are|was|were|gets?) (?:filled in|replaced|substituted|expanded)\b|{_LIST} (?:stands?|stood) for\b",
    r"(?iu:\b(?:returns?|returned|returning|equals?|throws?|yields?|holds?|contains?|becomes?|prints?|compared? (?:to|with)|check(?:s|ed|ing)? for|test(?:s|ed|ing)? for|instead of|rather than|(?:remain|leave|stay)(?:s|ed)?|left|(?:values?|results?) (?:of|is|are)|neither|either|not) )(?:undefined|NaN|null)\b",
    r"\bset to (?:undefined|NaN|null)(?=\W*$|[.,;:]| (?:if|when|by|and|or|until|unless|before|after)\b)|\b[Nn]ull sets?\b",
    r"\b(?:undefined|NaN|[Nn]ull)(?= (?:hypothes[ie]s|pointers?|devices?|modems?|vectors?|spaces?|distributions?|values?|bytes?|strings?|references?|objects?|results?|behaviou?rs?|terms?|checks?|models?|variables?|and (?:defined|void|undefined|NaN|null)|or (?:undefined|NaN|null|empty|zero|missing)|(?:is|are) (?:not|never|rejected|returned|used|allowed))\b)",
    r"\b[Aa]n? (?:undefined|NaN|null)(?= (?:\w+ed|in|on|of|from|is|was|that|which|values?)\b|[,;.])",
]


def units(text: Column) -> Column:
    """The sentences and lines of a text, trimmed, with one kind of apostrophe; null gives null."""
    return F.filter(F.transform(F.split(F.translate(text, "’‘", "''"), r"(?<=[.!?])\s+|\n"), lambda u: F.btrim(u, F.lit(" \t\r"))), lambda u: u != "")


def without_ids(unit: Column) -> Column:
    """A unit in lower case, hashes and long numbers as 0."""
    return F.regexp_replace(F.lower(unit), r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b", "0")


def normalised(unit: Column) -> Column:
    """A unit without what varies in it: lower case, hashes and numbers as 0."""
    return F.regexp_replace(without_ids(unit), r"\d+", "0")


def _any(text: Column, rules: list[tuple[str, str]], flags: str, held: Column) -> Column:
    """Whether a rule matches; its words, any case unless ``held`` keeps it, are looked for in ``held`` before."""
    def one(pattern: str, words: str) -> Column:
        first = [held.contains(w) for w in words.split("|") if w]
        return reduce(lambda a, b: a | b, first) & text.rlike(flags + pattern) if first else text.rlike(flags + pattern)

    return reduce(lambda a, b: a | b, (one(*rule) for rule in rules))


def _stated(text: Column, rules: list[tuple[str, str]], flags: str, held: Column) -> Column:
    """Whether a rule matches where no word directly before makes it an example or a name."""
    return _any(text, rules, flags, held) & _any(text, [(rf"(?<!\b{CITED}[ :,]{{0,2}})(?:{p})", w) for p, w in rules], flags, held)


def _unfilled(unit: Column) -> Column:
    """Whether a unit holds a field that it does not speak about."""
    rest = reduce(lambda u, p: F.regexp_replace(u, p, " "), SPOKEN_FIELDS, unit)
    return _any(unit, FIELDS, "(?u)", unit) & _any(rest, FIELDS, "(?u)", rest)


def _one_of(words) -> str:
    """A pattern for any of some words that tries their common beginnings once."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(at: dict) -> str:
        parts = [re.escape(c) + written(next_) for c, next_ in sorted(at.items()) if c]
        body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return "" if not parts else f"(?:{body})?" if "" in at else body

    return written(tree)


#: any word of filler or mashed keys
_KNOWN = _one_of({*FILLER_WORDS, *MASHED})


def without_quotes(unit: Column) -> Column:
    """A unit with quoted words, which are spoken about, as an empty quote."""
    said = F.when(~unit.rlike("[\"“„«]"), unit).otherwise(F.regexp_replace(unit, r"(?<!\{|:|,)[\"“„«](?![:,])[^\"“”„«»{}:]{2,60}[\"”“»]", '""'))  # quoted words are spoken about
    said = F.when(~said.contains(" '"), said).otherwise(F.regexp_replace(said, r"(?<= )'(?=\w)[^'{}:]{2,60}(?<=\w)'(?= )", '""'))
    return said


def kind(unit: Column, low: Column, said: Column) -> Column:
    """What kind of residue a unit is, or null: script, error, placeholder or filler. low, said: the unit in lower case and without_quotes; these are
    columns of their own, as they would be worked out anew for each rule."""
    flags = "(?iu)"
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    n = F.size(words)
    some = low.rlike(rf"(?u)\b{_KNOWN}\b")  # cheaper than counting, which few lines then need
    again = low.rlike(r"(?u)\b(\p{L}{2,40})[\s.,]{1,3}\1\b")  # groups that repeat without bound would recurse on long texts
    filler = F.size(F.filter(words, lambda w: w.isin(*FILLER_WORDS)))
    mashed = F.size(F.filter(words, lambda w: w.isin(*MASHED)))
    joining = F.size(F.filter(words, lambda w: w.isin(*FUNCTION_WORDS)))
    plain = joining > 0
    distinct = F.size(F.array_distinct(words))
    of_words = ((n >= 3) & ((filler >= 0.5 * n) | (mashed >= 0.6 * n))) | ((n >= 2) & (filler == n)) | ((n >= 5) & (filler >= 1) & ~plain) | ((filler >= 3) & (joining <= 0.1 * n)) | low.rlike(rf"(?u)\b(?:{'|'.join(MASHED)})(?:\W{{1,3}}(?:{'|'.join(MASHED)})\b){{2}}")
    # one word alone, or a word four times in a row (what a slot is called, three times), or few words over and over with none that joins them
    slots = low.rlike(rf"(?u)\b({SLOT})[\s.,]{{1,3}}\1[\s.,]{{1,3}}\1\b")
    repeated = slots | ((n >= 3) & (distinct == 1) & (F.length(words[0]) >= 3)) | low.rlike(r"(?u)\b(\p{L}{2,40})[\s.,]{1,3}\1[\s.,]{1,3}\1[\s.,]{1,3}\1\b") | ((n >= 6) & (distinct <= 0.5 * n) & ~plain)
    cited = low.rlike(rf"(?u)\b{CITED}[ :,]{{1,2}}(?:{_KNOWN}\b|(\p{{L}}{{2,40}})[\s.,]{{1,3}}\1[\s.,]{{1,3}}\1\b)")
    return (
        F.when(_stated(said, SCRIPT_NOTICES, flags, low), "script")
        .when(_stated(said, ERROR_PAGES, flags, low), "error")
        .when(_stated(said, PLACEHOLDER_PHRASES, flags, low) | _unfilled(unit), "placeholder")
        .when(((some & of_words) | (again & repeated)) & ~cited, "filler")
    )


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, host, line, kind): every unit of every document, its host (null is a host of its own), its normalised form's hash and its kind."""
    forms = lambda u: F.struct(u.alias("unit"), F.lower(u).alias("low"), without_quotes(u).alias("said"))  # noqa: E731  # made once, as many rules look at it
    exploded = spread(documents.select("doc_id", "source", "text")).select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.explode(F.transform(units(F.col("text")), forms)).alias("u"))
    return exploded.select("doc_id", "host", F.xxhash64(normalised(F.col("u.unit"))).alias("line"), kind(F.col("u.unit"), F.col("u.low"), F.col("u.said")).alias("kind"))


def _wholly_frame(documents: DataFrame, found: DataFrame, frame: DataFrame, size: DataFrame, rare: Column, flagged: DataFrame) -> DataFrame:
    """The rows of ``found`` of documents that hold evidence in frame lines only and have no content beside their host's frame.

    A unit is content unless it is evidence, a heading, without letters, or recurs in the host with at most its identifiers changed (other
    numbers tell content apart). Only documents of hosts whose frame holds evidence are read for it.
    """
    left = land(found.join(flagged, "doc_id", "left_anti"), "framed")
    hosts = left.select("host").distinct()
    of = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), "text").join(hosts, "host", "left_semi")
    each = spread(of).select("doc_id", "host", F.explode(units(F.col("text"))).alias("unit")).filter(F.col("unit").rlike(r"\p{L}") & ~F.col("unit").rlike(r"^#+\s[^.!?]*$"))
    other = each.select("doc_id", "host", F.xxhash64(normalised(F.col("unit"))).alias("line"), F.xxhash64(without_ids(F.col("unit"))).alias("form")).join(frame, ["host", "line"], "left_anti").select("doc_id", "host", "form").distinct()
    seen = other.groupBy("host", "form").agg(F.count(F.lit(1)).alias("docs")).join(size, "host").filter(rare).select("host", "form")
    content = other.join(left.select("doc_id").distinct(), "doc_id", "left_semi").join(seen, ["host", "form"], "left_semi").select("doc_id")
    return left.join(content, "doc_id", "left_anti")


def residue(documents: DataFrame, boilerplate_share: float = 0.05, boilerplate_least: int = 50) -> DataFrame:
    """(doc_id, kinds): the documents whose residual holds evidence, with the sorted kinds of it.

    Lines are counted by host in their normalised form, in documents, not occurrences. Those in more than boilerplate_share of a host's
    documents, and in boilerplate_least at least, are the host's frame and say nothing about one document; they are subtracted from
    documents that keep content beside it. Where nothing is kept, the frame stands in place of content and its evidence counts. What
    remains is residue if it is an error message, a placeholder, filler or a notice that scripts are required, as `kind` finds them; a
    sentence that mentions or quotes such a thing is none. Only lines with a kind can become evidence, so only these move, counted per
    task before they do. Null and empty texts hold no evidence. doc_id must be unique.
    """
    found = land(lines(documents.select("doc_id", "source", "text")).filter(F.col("kind").isNotNull()).distinct(), "evidence")
    size = documents.groupBy(F.coalesce("source", F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"))
    seen = found.select("doc_id", "host", "line").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    recurs = (F.col("docs") >= boilerplate_least) & (F.col("docs") > F.col("host_docs") * boilerplate_share)
    often = seen.filter(F.col("docs") >= boilerplate_least)
    frame = land(often.join(size, "host").filter(recurs).select("host", "line"), "frame")
    kept = found.join(frame, ["host", "line"], "left_anti")
    if not frame.isEmpty():
        kept = land(kept, "kept")
        kept = kept.unionByName(_wholly_frame(documents, found, frame, size, ~recurs, kept.select("doc_id").distinct()))
    return kept.groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def clean(documents: DataFrame, **options) -> DataFrame:
    """The documents without residue, all their columns kept."""
    return documents.join(residue(documents, **options).select("doc_id"), "doc_id", "left_anti")
