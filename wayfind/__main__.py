from wayfind.cli import main

main()
