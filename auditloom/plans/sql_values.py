"""Fixed values that the SQL compares with, written out again so that a slip in lexicons.py shows."""

TRACKING = ['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'gclid', 'fbclid', 'msclkid', 'mc_cid', 'mc_eid', 'ref', 'referrer',
 '_ga', 'yclid']
PAGE_TYPES = {'contact': ['contact', 'kontakt', 'contacto', 'contactez', 'get-in-touch', 'getintouch', 'reach-us', 'reachus', 'enquiry', 'enquire', 'inquiry',
             'contact-us'],
 'booking': ['book', 'booking', 'appointment', 'appointments', 'schedule', 'reserve', 'reservation', 'book-now', 'book-online', 'make-appointment',
             'buchen'],
 'about': ['about', 'about-us', 'aboutus', 'who-we-are', 'our-story', 'company', 'ueber-uns', 'sobre', 'notre-histoire'],
 'team': ['team', 'our-team', 'staff', 'people', 'meet-the-team', 'our-people', 'practitioners', 'doctors', 'stylists', 'therapists'],
 'services': ['service', 'services', 'what-we-do', 'treatments', 'solutions', 'offerings', 'products', 'menu', 'our-work', 'specialties',
              'leistungen'],
 'pricing': ['pricing', 'prices', 'price-list', 'rates', 'packages', 'plans', 'cost', 'fees', 'tariff'],
 'testimonials': ['testimonial', 'testimonials', 'reviews', 'review', 'feedback', 'client-stories', 'case-studies', 'case-study', 'portfolio',
                  'gallery', 'our-work', 'projects'],
 'locations': ['location', 'locations', 'areas-we-serve', 'service-area', 'service-areas', 'find-us', 'branches', 'stores', 'coverage',
               'where-we-work'],
 'quote': ['quote', 'get-a-quote', 'request-quote', 'free-quote', 'estimate', 'free-estimate', 'request-estimate']}
PAGE_PRIORITY = {'homepage': 0,
 'contact': 1,
 'about': 2,
 'services': 3,
 'booking': 4,
 'team': 5,
 'testimonials': 6,
 'pricing': 7,
 'locations': 8,
 'quote': 9,
 'other': 20}
SKIP_PARTS = ['privacy', 'terms', 'cookie', 'gdpr', 'disclaimer', 'sitemap.xml', '/tag/', '/tags/', '/author/', '/category/', '/wp-admin', '/wp-login', '/cart',
 '/checkout', '/account', '/login', '/signin', '/register', '/feed', '?add-to-cart', '/wp-json']
BOOKING = ['book now', 'book online', 'book a', 'book an', 'make a booking', 'booking', 'appointment', 'make an appointment', 'schedule', 'reserve',
 'reservation', 'request a visit', 'arrange a visit']
QUOTE = ['get a quote', 'free quote', 'request a quote', 'get quote', 'free estimate', 'request an estimate', 'get pricing', 'request pricing',
 'instant quote']
CONSULT = ['consultation', 'free consultation', 'book a consultation', 'talk to us', 'speak to us', 'discovery call', 'free assessment']
CONTACT = ['contact us', 'contact', 'get in touch', 'reach us', 'enquire', 'enquiry', 'inquire', 'inquiry', 'send us a message', 'message us', 'email us',
 'call us']
STRONG_CTA = ['call', 'contact']
GENERIC_CTA = ['submit', 'send', 'click here', 'read more', 'learn more', 'more', 'go', 'ok']
BOOKING_PLATFORMS = ['calendly.com', 'acuityscheduling.com', 'squareup.com/appointments', 'booksy.com', 'fresha.com', 'treatwell', 'setmore.com', 'simplybook.me',
 'mindbodyonline.com', 'opentable.com', 'resy.com', 'sevenrooms.com', 'timely.com', 'vagaro.com', 'square.site', 'schedulicity.com', 'appointy.com',
 '10to8.com', 'youcanbook.me', 'cal.com', 'housecallpro.com', 'jobber.com', 'servicetitan.com', 'zocdoc.com']
TESTIMONIAL = ['testimonial', 'testimonials', 'what our clients say', 'what our customers say', 'client stories', 'customer stories', 'reviews', 'review', 'rated',
 '5 star', 'five star', 'happy clients', 'happy customers', 'kind words', 'success stories']
CREDENTIAL = ['licensed', 'licence', 'license', 'insured', 'certified', 'certification', 'accredited', 'accreditation', 'qualified', 'member of', 'registered',
 'award', 'awards', 'award-winning', 'gas safe', 'niceic', 'checkatrade', 'city & guilds', 'bbb accredited', 'iso 900', 'years of experience',
 'years experience', 'established in', 'since 19', 'since 20', 'guarantee', 'warranty', 'dbs checked', 'fully insured']
PORTFOLIO = ['portfolio', 'our work', 'case study', 'case studies', 'gallery', 'projects', 'before and after', 'before & after', 'recent work', 'past work']
HOURS = ['opening hours', 'open hours', 'business hours', 'hours of operation', 'we are open', 'mon-fri', 'mon - fri', 'monday to friday', 'monday - friday',
 'monday-friday', 'open today', 'opening times']
SERVICE_AREA = ['areas we serve', 'service area', 'service areas', 'areas covered', 'we cover', 'serving', 'we serve', 'coverage area', 'locations we serve',
 'surrounding areas']
SERVICES = ['services', 'what we do', 'we offer', 'our work', 'treatments', 'solutions', 'specialise', 'specialize', 'products', 'menu']
EMPTY_HEADINGS = ['welcome', 'home', 'welcome to our website', 'welcome to our site', 'homepage']
STRONG = ['no_primary_cta_above_fold', 'no_phone_cta', 'no_contact_form', 'no_booking_cta', 'missing_viewport', 'viewport_not_responsive',
 'no_mobile_tap_to_call', 'no_phone_on_site', 'contact_hard_to_find', 'broken_internal_links', 'slow_response', 'pagespeed_low', 'no_testimonials',
 'very_thin_homepage', 'services_not_clear', 'no_https', 'noindex', 'fixed_width_layout', 'no_website_detected', 'social_profile_only',
 'no_email_on_site']
WEIGHTS = {'technical': 20, 'mobile': 20, 'conversion': 25, 'trust': 15, 'contact': 10, 'content': 10}
CARD_WEIGHTS = {'technical': 13, 'onpage': 13, 'local_seo': 10, 'offpage': 5, 'performance': 13, 'accessibility': 9, 'security': 13, 'ux_conversion': 24}
TIERS = [(90, 'Very High'), (75, 'High'), (60, 'Good'), (40, 'Moderate'), (0, 'Low')]
CHECKS = [('https', 'security', ['no_https']), ('mixed_content', 'security', ['mixed_content']), ('hsts', 'security', ['security_hsts_missing']),
 ('csp', 'security', ['security_csp_missing']), ('frame_protection', 'security', ['security_frame_protection_missing']),
 ('xcto', 'security', ['security_xcto_missing']), ('referrer_policy', 'security', ['security_referrer_policy_missing']),
 ('indexable', 'technical', ['noindex']), ('sitemap', 'technical', ['missing_sitemap']), ('robots_txt', 'technical', ['missing_robots']),
 ('broken_links', 'technical', ['broken_internal_links']), ('redirects', 'technical', ['long_redirect_chain']),
 ('title', 'onpage', ['missing_title', 'title_too_short', 'title_too_long']),
 ('meta_description', 'onpage', ['missing_meta_description', 'meta_description_short']), ('h1', 'onpage', ['missing_h1', 'multiple_h1']),
 ('canonical', 'onpage', ['missing_canonical']), ('open_graph', 'onpage', ['onpage_missing_open_graph']),
 ('twitter_card', 'onpage', ['onpage_missing_twitter_card']), ('duplicate_titles', 'onpage', ['onpage_duplicate_titles']),
 ('viewport', 'ux_conversion', ['missing_viewport', 'viewport_not_responsive']), ('tap_to_call', 'ux_conversion', ['no_mobile_tap_to_call']),
 ('fixed_width', 'ux_conversion', ['fixed_width_layout']), ('mobile_menu', 'ux_conversion', ['no_mobile_menu']),
 ('alt_text', 'accessibility', ['low_alt_coverage']), ('lang', 'accessibility', ['missing_lang']),
 ('main_landmark', 'accessibility', ['a11y_no_main_landmark']), ('form_labels', 'accessibility', ['a11y_unlabelled_form_inputs']),
 ('link_text', 'accessibility', ['a11y_empty_links']), ('response_time', 'performance', ['slow_response']),
 ('page_weight', 'performance', ['heavy_page']), ('compression', 'performance', ['perf_no_compression']),
 ('render_blocking', 'performance', ['perf_render_blocking_scripts']), ('phone_cta', 'ux_conversion', ['no_phone_cta']),
 ('contact_form', 'ux_conversion', ['no_contact_form']), ('contact_page', 'ux_conversion', ['no_contact_page']),
 ('testimonials', 'ux_conversion', ['no_testimonials']), ('credentials', 'ux_conversion', ['no_credentials']),
 ('address', 'ux_conversion', ['no_address']), ('social_profiles', 'offpage', ['offpage_no_social_profiles']),
 ('local_business_schema', 'local_seo', ['local_no_business_schema']), ('local_address', 'local_seo', ['local_no_address_signal']),
 ('local_map_or_gbp', 'local_seo', ['local_no_map_or_gbp_link']), ('local_service_area', 'local_seo', ['local_no_service_area_content']),
 ('local_hours', 'local_seo', ['local_no_opening_hours']), ('local_reviews', 'local_seo', ['local_no_reviews_or_testimonials']),
 ('local_reviews_structured', 'local_seo', ['local_reviews_not_structured']), ('local_name_consistency', 'local_seo', ['local_name_mismatch'])]
NOT_VERIFIED = [('color_contrast', 'accessibility'), ('backlink_profile', 'offpage'), ('domain_authority', 'offpage')]
CARD = [
    ('noindex', 'technical'),
    ('missing_sitemap', 'technical'),
    ('missing_robots', 'technical'),
    ('broken_internal_links', 'technical'),
    ('long_redirect_chain', 'technical'),
    ('no_https', 'security'),
    ('mixed_content', 'security'),
    ('missing_title', 'onpage'),
    ('title_too_short', 'onpage'),
    ('title_too_long', 'onpage'),
    ('missing_meta_description', 'onpage'),
    ('meta_description_short', 'onpage'),
    ('missing_h1', 'onpage'),
    ('multiple_h1', 'onpage'),
    ('missing_canonical', 'onpage'),
    ('generic_value_proposition', 'onpage'),
    ('no_heading_structure', 'onpage'),
    ('very_thin_homepage', 'onpage'),
    ('thin_homepage', 'onpage'),
    ('services_not_clear', 'onpage'),
    ('no_service_area', 'onpage'),
    ('missing_lang', 'accessibility'),
    ('low_alt_coverage', 'accessibility'),
    ('slow_response', 'performance'),
    ('heavy_page', 'performance'),
    ('many_scripts', 'performance'),
    ('pagespeed_low', 'performance'),
    ('missing_viewport', 'ux_conversion'),
    ('viewport_not_responsive', 'ux_conversion'),
    ('zoom_disabled', 'ux_conversion'),
    ('fixed_width_layout', 'ux_conversion'),
    ('small_mobile_text', 'ux_conversion'),
    ('no_mobile_tap_to_call', 'ux_conversion'),
    ('legacy_plugin_content', 'ux_conversion'),
    ('no_mobile_menu', 'ux_conversion'),
    ('minimal_navigation', 'ux_conversion'),
    ('no_primary_cta_above_fold', 'ux_conversion'),
    ('no_phone_cta', 'ux_conversion'),
    ('no_contact_form', 'ux_conversion'),
    ('no_booking_cta', 'ux_conversion'),
    ('no_quote_cta', 'ux_conversion'),
    ('no_email_cta', 'ux_conversion'),
    ('no_contact_page', 'ux_conversion'),
    ('weak_cta_language', 'ux_conversion'),
    ('no_testimonials', 'ux_conversion'),
    ('reviews_not_structured', 'ux_conversion'),
    ('no_credentials', 'ux_conversion'),
    ('no_portfolio', 'ux_conversion'),
    ('no_about_page', 'ux_conversion'),
    ('no_phone_on_site', 'ux_conversion'),
    ('phone_not_on_homepage', 'ux_conversion'),
    ('no_email_on_site', 'ux_conversion'),
    ('no_address', 'ux_conversion'),
    ('no_opening_hours', 'ux_conversion'),
    ('contact_hard_to_find', 'ux_conversion'),
    ('no_website_detected', 'ux_conversion'),
    ('social_profile_only', 'ux_conversion'),
    ('no_social_presence_linked', 'offpage'),
]
PREFERRED = ['info', 'hello', 'contact', 'enquiries', 'enquiry', 'inquiries', 'office', 'sales', 'bookings', 'booking', 'appointments', 'reception', 'hi', 'team',
 'admin', 'support', 'help', 'service']
ROLES = ['info', 'hello', 'contact', 'sales', 'support', 'enquiries', 'enquiry', 'inquiries', 'admin', 'office', 'team', 'help', 'service', 'customerservice',
 'bookings', 'booking', 'reception', 'mail', 'hi', 'hey', 'ask', 'general', 'reservations', 'appointments', 'orders', 'accounts', 'billing', 'care',
 'frontdesk', 'studio']
JUNK_DOMAINS = ['example.com', 'example.org', 'example.net', 'domain.com', 'yourdomain.com', 'yoursite.com', 'email.com', 'test.com', 'sentry.io',
 'sentry-next.wixpress.com', 'wixpress.com', 'wix.com', 'squarespace.com', 'godaddy.com', 'shopify.com', 'w3.org', 'schema.org', 'adobe.com',
 'googleapis.com', 'gstatic.com', 'cloudflare.com', 'jquery.com', 'bootstrapcdn.com', 'fontawesome.com', 'gravatar.com', 'placeholder.com',
 'mysite.com', 'site.com', 'company.com']
JUNK_LOCALS = ['example', 'user', 'username', 'your', 'youremail', 'email', 'name', 'test', 'someone', 'john.doe', 'jane.doe', 'firstname', 'lastname',
 'no-reply-test', 'domain', 'yourname', 'mail', 'abc', 'xyz', 'sample']
JUNK_PREFIXES = ['no-reply', 'noreply', 'donotreply', 'do-not-reply', 'mailer-daemon', 'postmaster', 'abuse', 'wordpress', 'wp', 'root']
FILE_ENDINGS = ['png', 'jpg', 'jpeg', 'gif', 'svg', 'webp', 'ico', 'bmp', 'tiff', 'css', 'js', 'json', 'xml', 'woff', 'woff2', 'ttf', 'eot', 'mp4', 'webm', 'pdf',
 'zip']
STREET = r"(?i)\b[0-9]{1,5}\s+[a-z][a-z.\- ]{3,40}\s+(street|st|road|rd|avenue|ave|lane|ln|drive|dr|way|court|ct|boulevard|blvd|place|pl|parade|terrace)\b"
MAP_LINK = r"(?i)google\.com/maps|maps\.google\.|goo\.gl/maps|g\.page/|business\.google\.com"
LOCAL_AREA = r"(?i)\b(areas we serve|service areas?|areas covered|locations we serve|our service area)\b"
PARKED = [
    ('domain is for sale', 'The domain appears to be listed for sale.'),
    ('buy this domain', 'The domain appears to be listed for sale.'),
    ('under construction', 'The page says it is under construction.'),
    ('coming soon', 'The page says it is coming soon.'),
    ('site is temporarily unavailable', 'The host reports the site as unavailable.'),
    ('default web page', "This is the hosting provider's default page."),
    ('welcome to nginx', 'This is an unconfigured nginx default page.'),
    ('apache2 ubuntu default page', 'This is an unconfigured Apache default page.'),
    ('future home of something quite cool', 'This is a hosting placeholder page.'),
    ('this domain is parked', 'The domain is parked.'),
]
SUFFIXES = ['co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'me.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'org.nz', 'com.pk', 'net.pk', 'org.pk', 'co.in', 'net.in', 'org.in',
 'co.za', 'org.za', 'com.br', 'co.jp', 'com.mx', 'com.tr', 'com.sg', 'com.my', 'com.hk']
TOPIC = [
    ('no_primary_cta_above_fold', 'call to action'),
    ('no_phone_cta', 'phone contact'),
    ('no_contact_form', 'enquiry form'),
    ('no_booking_cta', 'booking'),
    ('no_contact_page', 'contact page'),
    ('weak_cta_language', 'call to action wording'),
    ('no_quote_cta', 'quote request'),
    ('no_email_cta', 'written contact'),
    ('social_profile_only', 'no owned website'),
    ('no_website_detected', 'no website'),
    ('missing_viewport', 'mobile layout'),
    ('viewport_not_responsive', 'mobile layout'),
    ('no_mobile_tap_to_call', 'mobile calling'),
    ('fixed_width_layout', 'mobile layout'),
    ('no_mobile_menu', 'mobile navigation'),
    ('zoom_disabled', 'mobile accessibility'),
    ('small_mobile_text', 'mobile readability'),
    ('no_phone_on_site', 'phone contact'),
    ('phone_not_on_homepage', 'phone visibility'),
    ('contact_hard_to_find', 'finding contact details'),
    ('no_email_on_site', 'email contact'),
    ('no_address', 'location'),
    ('no_opening_hours', 'opening hours'),
    ('no_testimonials', 'customer proof'),
    ('no_credentials', 'credentials'),
    ('no_portfolio', 'examples of work'),
    ('no_about_page', 'about the business'),
    ('reviews_not_structured', 'review markup'),
    ('no_social_presence_linked', 'social links'),
    ('no_https', 'site security'),
    ('noindex', 'search visibility'),
    ('slow_response', 'page speed'),
    ('pagespeed_low', 'page speed'),
    ('broken_internal_links', 'broken links'),
    ('missing_title', 'search listing'),
    ('missing_meta_description', 'search listing'),
    ('missing_h1', 'page structure'),
    ('mixed_content', 'site security'),
    ('low_alt_coverage', 'image accessibility'),
    ('missing_sitemap', 'search crawling'),
    ('heavy_page', 'page weight'),
    ('very_thin_homepage', 'homepage content'),
    ('thin_homepage', 'homepage content'),
    ('services_not_clear', 'services'),
    ('generic_value_proposition', 'main heading'),
    ('no_service_area', 'service area'),
    ('minimal_navigation', 'navigation'),
    ('no_heading_structure', 'page structure'),
]
