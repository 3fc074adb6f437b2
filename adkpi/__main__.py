from adkpi.cli import main

main()
