"""Sentences of no generator: usual messages, placeholders and filler of web pages, and sentences that only resemble or speak about them."""

#: looked at while the rules were made
LEFT = [
    'You need to enable JavaScript to run this app.',
    'HTTP 404 Not Found',
    '503 Service Temporarily Unavailable',
    'Error establishing a database connection',
    'JavaScript must be enabled in order to view this page.',
    'We’re sorry but this application doesn’t work properly without JavaScript enabled. Please enable it to continue.',
    'Dear [First Name], your order [Order Number] has shipped.',
    'Welcome back, {{ user.profile.preferences.display_name.with_a_very_long_suffix.and_more }}!',
    'Hello world! Welcome to WordPress. This is your first post. Edit or delete it, then start writing!',
    'Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.',
    'Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.',
    'Lorem ipsum dolor sit amet, consectetur adipiscing elit.',
    'Your browser does not support JavaScript or it is disabled.',
    'This page requires JavaScript to function correctly.',
    'JavaScript is disabled in your browser. Please enable JavaScript to proceed.',
    'For full functionality of this site it is necessary to enable JavaScript.',
    'Checking your browser before accessing the site. This process is automatic.',
    "Access denied. You don't have permission to access this resource.",
    'The requested URL was not found on this server.',
    'Sorry, the page you are looking for could not be found.',
    'Oops! Something went wrong. Please try again later.',
    '500 Internal Server Error',
    '502 Bad Gateway nginx/1.18.0',
    'An unexpected error has occurred. Please refresh the page.',
    "This site can't be reached. The connection was reset.",
    'Application error: a client-side exception has occurred (see the browser console for more information).',
    "Uncaught TypeError: Cannot read properties of undefined (reading 'map')",
    'Traceback (most recent call last): File "app.py", line 10, in <module>',
    'Fatal error: Uncaught Error: Call to undefined function get_header() in /var/www/html/index.php:17',
    "Warning: mysql_connect(): Access denied for user 'root'@'localhost' in /var/www/db.php on line 5",
    'java.lang.NullPointerException at com.example.Main.run(Main.java:42)',
    'Please insert your company name here.',
    '[Insert your bio here]',
    'Lorem ipsum',
    'TODO: add description',
    'Add your text here',
    'Click here to edit this text.',
    "This is a sample page. It's different from a blog post because it will stay in one place.",
    'Product description goes here.',
    'Hello {name}, thanks for subscribing to {newsletter_name}.',
    'Price: ${{price}} for {{quantity}} items',
    'Dear %FIRSTNAME%, your invoice is attached.',
    'Hi %s, you have %d new messages.',
    '<%= user.name %> liked your photo',
    'Created by [Your Name Here] in [Year].',
    'The quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog.',
    'asdf asdf asdf asdf',
    'test test test',
    'The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.',
    '429 Too Many Requests',
    'Sorry, you have been blocked. You are unable to access this site.',
    'Please turn JavaScript on and reload the page.',
    'To use this application, please enable JavaScript.',
    'Bitte aktivieren Sie JavaScript in Ihrem Browser.',
    'Veuillez activer JavaScript pour continuer.',
    'Por favor, active JavaScript en su navegador.',
    'Diese Seite konnte nicht gefunden werden.',
    'Page introuvable. Erreur 404.',
    'Página não encontrada',
    'Una página de error: Error 500 - error interno del servidor',
    'Please enable scripts and reload this page.',
    'You must enable JavaScript in your browser to use this website.',
    'Our website needs JavaScript to work. Please switch it on.',
    'This content cannot be displayed without JavaScript.',
    'JavaScript seems to be disabled in your browser.',
    'Sorry, this game does not run without JavaScript.',
    'Enable JavaScript to see this gallery.',
    'Debe habilitar JavaScript para ver esta página.',
    'Error 403: Forbidden',
    '404 - File or directory not found.',
    'The page you requested does not exist.',
    'Whoops, looks like something went wrong.',
    'An error occurred while processing your request.',
    'Our services are currently unavailable. Please try again later.',
    'Database connection failed: too many connections',
    'The site is currently down for maintenance.',
    'Your session has expired. Please log in again.',
    'Exception in thread "main" java.lang.IllegalStateException: no context',
    'Parse error: syntax error, unexpected end of file in /srv/www/page.php on line 88',
    'Unable to load content. Check your internet connection.',
    'This video is no longer available.',
    'Request timed out. Reference: 8f3a2b1c',
    'La página que busca no existe.',
    'Die Seite, die Sie suchen, wurde nicht gefunden.',
    'Dear {{customer_name}}, welcome aboard.',
    'By [AUTHOR], published on [DATE]',
    'Artist: <artist name>',
    'Total: $TOTAL_PRICE$ including tax',
    'Hi ${firstName}, here are your ${count} updates.',
    '@@TITLE@@ was minted in @@YEAR@@.',
    'Enter your description here.',
    'Write a short bio about yourself here.',
    'Your tagline goes here',
    'Placeholder text, replace before publishing.',
    '[Add a subtitle]',
    'TBD',
    'Double-click to edit this paragraph.',
    'Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.',
    'Lorem ipsum dolor sit amet elit sed do.',
    'Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris.',
    'qwer asdf zxcv qwer',
    'blah blah blah blah',
    'sample sample sample sample',
    "We're sorry, but this page requires JavaScript.",
    'JavaScript is turned off in your browser.',
    'Scripts are blocked. Allow them to continue.',
    'To view the artwork, please enable JavaScript.',
    "This application won't load without JavaScript enabled.",
    'Veuillez activer JavaScript dans votre navigateur.',
    'Server error: please retry in a few minutes.',
    '404: This page could not be found.',
    "Sorry, we couldn't find that page.",
    'The page you were looking for has been removed.',
    '504 Gateway Timeout',
    "403 Forbidden - you don't have permission to access this resource.",
    'Something went wrong. Please reload.',
    'Service unavailable',
    'Failed to fetch metadata.',
    'Fehler 404: Seite nicht gefunden',
    'TypeError: undefined is not a function at render (app.js:12)',
    'The request could not be completed. Try again later.',
    'Connection refused',
    'Hello [Name], your mint is ready.',
    'Thanks for buying {{ item_title }} from {{ store }}.',
    'Posted by <username> on <date>',
    'Dear %CUSTOMER_NAME%, your wallet is ready.',
    'Floor price: undefined ETH',
    'Minted on NaN/NaN/NaN',
    'Owner: [object Object]',
    'Short description goes here.',
    'Insert image here',
    '[Your text here]',
    'TODO: write copy',
    'Add a title here',
    'Edit this text in the settings.',
    'Lorem ipsum dolor',
    'Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.',
    'Curabitur pellentesque mauris vestibulum lacus.',
    'test test test test',
    'asdfasdf asdf qwer asdf',
]

SPOKEN = [
    'The null hypothesis is rejected.',
    'The device returns null if the sensor is off.',
    'JavaScript is a programming language that runs in the browser.',
    'The error rate fell to 404 cases in March.',
    'Room 503 is available for bookings.',
    'The page turned yellow over the years and could not be restored.',
    'She found the letter could not be delivered because the road was closed.',
    "In the template you can use a placeholder such as {{name}} to insert the customer's name.",
    'The function returns undefined when called without arguments.',
    'A value of NaN is not equal to itself.',
    'Lorem ipsum is a placeholder text used in typesetting since the 1500s.',
    'Our lorem ipsum generator creates filler text for designers.',
    'The movie "Error 404" premiered last night.',
    'Users who see a 404 page should check the address.',
    'The museum does not work without volunteers.',
    'Enable notifications in the settings to get price alerts.',
    'Please enter your name and address below and send the form to us.',
    'The guide to error handling explains how exceptions propagate.',
    'He was not found guilty by the jury.',
    'Service is available from 8 to 17 on weekdays.',
    'Type your address into the search field and press enter.',
    'The collection holds 404 pieces.',
    'We are sorry to hear that you were unhappy with the delivery.',
    'The bridge was closed for maintenance last week.',
    'Access to the archive is free on Sundays.',
    'The artist left the lower part blank, an unfinished template for visitors.',
    'The developers disabled scripts in the sandbox to prevent attacks.',
    'Some browsers block scripts by default, which is why the gallery was rebuilt without them.',
    'The warning came too late for the crew.',
    'Fatal accidents have fallen since 2010.',
    'The test was repeated three times with the same result.',
    'There are 500 internal rooms in the palace.',
    'A bad gateway in the wall let the water in.',
    'The room was dark, dark as the sea.',
    'No, no, no: that is not how the game works.',
    'The variable ${HOME} holds the path of the home directory.',
    'Printf replaces %s by the next argument.',
    'See the docs for the [options] that the command takes.',
    'The study compared undefined and defined benefit plans.',
    'The price is $5 and $10 for two.',
    'Costs rose by 5% in March and 10% in April.',
    'The contract was declared null and void.',
    'Please try again later in the season, when the berries are ripe.',
    'The server was friendly and brought our food quickly.',
    'Your story goes on here with the second part.',
    'Scripts for the new play are required by Friday.',
    'The library requires JavaScript developers to sign a contributor agreement.',
    'Click the button to edit the text and save it.',
    'Sample pages of the book are on the website.',
    'The fox is quick, brown and known for jumping.',
    'This is where the river meets the sea.',
    'Insert the key here and turn it clockwise.',
    'Page 404 of the manuscript is missing.',
    'The error was not found until the book was printed.',
    'Write your name here and win a prize.',
    "The term 'internal server error' confuses most readers.",
    'Visitors reported that the page could not be loaded on phones, so the team fixed it.',
    'The dog barked, barked and barked until morning.',
    'Maintenance of the harbour is due in May.',
    'Test results for the test series were published.',
    'Scripts were banned from the tournament after the scandal.',
    'We wrote the engine in JavaScript because the browser runs it everywhere.',
    'The site loads quickly even with JavaScript turned off.',
    'Activate the kiln before you glaze the pots.',
    'You can enable dark mode in the settings.',
    'There were 404 entries in the competition and 12 winners.',
    'The requested song was played twice.',
    'He made an error in the second movement and stopped.',
    'The error occurred in the ledger of 1923 and was never corrected.',
    'The connection between the two works was lost over time.',
    'The gallery is closed for maintenance until May.',
    'Your session with the curator starts at noon.',
    'The page was torn, the ink had faded.',
    'The committee was unable to reach a decision.',
    'Access to the roof is denied to visitors.',
    'The server brought two bowls of soup.',
    'Too many requests for signatures tired the artist.',
    'Not found among the papers was the deed of sale.',
    'The video shows a harbour at dawn.',
    'A null result is still a result.',
    'The null device discards all output.',
    'His motives remain undefined to this day.',
    'Square brackets [like these] mark additions by the editor.',
    'The poem reads: [illegible] by the sea [torn].',
    'The price tag reads $5 and the token sells for $7.',
    'The song repeats: run, run, run, and then stops.',
    'Many, many people came to the opening.',
    'Enter the hall through the east gate.',
    'Write to us about your visit.',
    'The description here differs from the one in the catalogue.',
    'Add salt here and stir.',
    'A placeholder bid keeps the auction open.',
    'The sample text was printed in seven typefaces.',
    'Lorem is the name of her cat.',
    'The Latin motto reads carpe diem.',
    'The test of time is kind to her work.',
    'Foo Fighters played a bar in Boston.',
    'Replace the filter every month.',
    'The title is not yet known.',
    'The date has to be decided by the owners.',
    'Headlines about the sale went around the world.',
    'The template of the mural hangs in the museum.',
    'Gold, silver, bronze, iron, tin and lead were used.',
    'JavaScript is turned into bytecode before it runs.',
    'Scripts for actors are blocked out on paper first.',
    'The artist enables others to continue the series.',
    'Servers in the restaurant make an error now and then.',
    'Page 40 could not be found in any copy of the book.',
    "We couldn't find that melody anywhere else.",
    'The statue you were looking at has been moved to the east wing.',
    'The gateway to the temple dates from 504.',
    'Something went wrong in the kiln and the glaze cracked.',
    'The service was unavailable to passengers for a week in 1988.',
    'They failed to fetch a good price.',
    'The request could not be ignored by the board.',
    'She refused the connection between both works.',
    'Hello and welcome to the spring edition.',
    'Sets such as {1, 2, 3} are finite.',
    'The list is sorted by [date] and <name> in the examples below.',
    'The floor is undefined territory for the dancers.',
    'Cells may hold NaN if a sensor fails.',
    'The object is an object of desire.',
    'A short description of each piece follows.',
    'The image here is a detail of the mural.',
    'Your text will be published in autumn.',
    'To do: nothing but sit and watch the sea.',
    'The editor asked her to edit the text again.',
    'The filler was used between two bricks.',
    'Dolor is the Latin word for pain.',
    'The test was a test of patience.',
    'Knock, knock, knock went the guard at the door.',
    'Blue on blue on blue: a study in one colour.',
    'Placeholders in the form are replaced before the letter goes out.',
    'Errors happen, and the site explains how to report them.',
    'A moderator may remove pages that break the rules.',
    'Please reload the camera with film.',
    'Allow three days for shipping.',
    'The number 500 is painted on the door.',
    'The date and the title are engraved on the base.',
    'Each token carries a title and a date.',
]

#: written afterwards and measured once
LEFT_UNSEEN = [
    'This website uses features that need JavaScript. Please enable it.',
    'Enable JavaScript in your browser settings to continue.',
    'Our viewer does not work without scripts.',
    'JavaScript is currently disabled.',
    'Activez JavaScript pour voir cette page.',
    'Error 502: bad gateway',
    'HTTP Error 500',
    'The page cannot be displayed.',
    'Oops, an error occurred.',
    'This listing is no longer available.',
    'Could not connect to the server.',
    'Gateway timeout. Please retry.',
    'ValueError: invalid literal for int()',
    'Hi {{first_name}}!',
    'Sold by [Seller Name] on [Sale Date].',
    'Delivered to %ADDRESS%.',
    'Price: NaN',
    'Sold to undefined for undefined ETH',
    'Insert product description here',
    'Your bio goes here.',
    'Type your message here...',
    'TODO: replace this text',
    'Sample text, replace before launch.',
    'Ut enim ad minima veniam, quis nostrum exercitationem ullam corporis suscipit laboriosam.',
    'Lorem ipsum dolor sit amet.',
    'blah blah blah',
    'foo bar baz foo bar',
]

SPOKEN_UNSEEN = [
    'JavaScript and Python are taught in the course.',
    'Viewers do not need scripts to follow the play.',
    'The error in 502 words was corrected.',
    'The gateway was designed in 1500.',
    'Oops was the title of his first song.',
    'The server said the kitchen was closed.',
    'Hi there, welcome to the harbour walk.',
    'The seller named the date in a letter.',
    'The address was painted over.',
    'The function is undefined at zero.',
    'NaN stands for not a number.',
    'The product description is in the appendix.',
    'His bio follows on page four.',
    'Type designers met in Leipzig.',
    'The sample was replaced before the launch.',
    'Foo is a town in the north.',
    'The lorem generator on that page is popular.',
    'Exceptions prove the rule.',
    'He could not connect to the audience.',
    'The site of the temple is closed.',
    'The connection of both towers is a bridge.',
    'The timeout was called by the coach.',
    'A page of the diary describes the storm.',
    'The field named {{owner}} is replaced at build time.',
    'Enable the alarm before leaving.',
    'Insert the coin and pull the lever.',
    'The text here is short.',
]
